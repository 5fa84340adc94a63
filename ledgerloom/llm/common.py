"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters between words ([\x20\x09-\x0D]); bytes.split() splits on the same ones.
WHITESPACE = " \t\n\x0b\x0c\r"

_own_folder: str | None = None
_cleared: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, in local mode (tests) a folder of our own; on a cluster each machine would write to its own disk."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="ledgerloom-")
        folder = f"file://{_own_folder}"
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder; each call gives another, so reruns never read older files.

    All of an application's are in one folder, which goes when the driver's process ends."""
    root = f"{shared_folder(spark)}/ledgerloom/{spark.sparkContext.applicationId}"
    if root not in _cleared:
        _cleared.add(root)
        at_end(spark, lambda: drop_scratch(spark, root))
    return f"{root}/{what}-{uuid.uuid4().hex}"


def at_end(spark: SparkSession, clear: Callable[[], object]) -> None:
    """Call clear when the driver's process ends, if the session still runs then."""
    def run() -> None:
        with contextlib.suppress(Exception):
            clear()

    atexit.register(run)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() gave, once nothing reads it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, fs = hadoop_path(spark, path)
    stream = fs.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, text: str, target: str, aside: str) -> bool:
    """Write a small file under a fresh name in the folder `aside` and rename it to target, there as a whole or not at all;
    False if target exists. (The rename must be atomic, as on HDFS or a local disk.)"""
    source, fs = hadoop_path(spark, f"{aside}/{uuid.uuid4().hex}")
    stream = fs.create(source, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    new, _ = hadoop_path(spark, target)
    fs.mkdirs(new.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(source, new, options)
    except Exception:
        if not fs.exists(new):
            raise
        fs.delete(source, False)
        return False
    return True


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs' rows as one struct column `row`, so that no name of theirs clashes, and columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The strings of an Arrow column as UTF-8; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def arrow_batches(batches):
    """Batches of a mapInArrow call that have rows."""
    return (b for b in batches if b.num_rows)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df with the highest counts, `most` at most: all from some count on, so that nothing is sorted.

    A histogram of counts (single ones up to 1024, then 64 steps to the doubling) decides from which."""
    c = F.col(count)
    bucket = F.when(c <= 1024, c.cast("int")).otherwise((F.log2(c) * 64).cast("int") + 1024)
    rows = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()  # a few thousand at most
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["bucket"]):
        total += r["n"]
        if total > most:
            break
        least = r["bucket"]
    return df.where(bucket >= least) if least is not None else df.limit(0)
