"""Size-tiered shards under versioned manifests.

A store is a folder. Each arrival becomes a run: some small immutable Parquet files. A version is a manifest,
the list of the runs that are live with their files, bytes and rows. It is written aside and renamed to the
version's name, which fails if another writer was first; so a version is there as a whole or not at all, and
a writer that dies before the rename leaves files that no manifest lists. (The rename must be atomic, as on
HDFS or a local disk; Structured Streaming's checkpoints ask for the same.) A writer that was second reads
the new version and applies its change to that.

Compaction sorts the runs by size into tiers of similar ones: a run belongs to a tier while it is at most
`RATIO` times the mean of those before it. Of a tier of `fanout` runs or more, each `fanout` are merged into one
run of files of about `target_bytes`, and committed; so no merge is larger than `fanout` times its largest run, and
merged runs fill the next tier. That goes on until no tier is full. `PARALLEL` merges of a tier run at a time. Merged
runs keep their files, for readers of older versions, until vacuum() is called: it deletes what no version of the
last `retain_seconds` lists.

All rows move by Spark's readers and writers; the driver sees manifests alone, a line for each live run.

Defined results: the rows of all arrivals, unchanged and with repetitions, nulls, empty and very long texts
and extra columns of any name; an empty arrival adds no run; an empty store reads as an empty table of the
given schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_scratch, scratch

TARGET_BYTES = 128 << 20
FANOUT = 8
#: Merges of a tier that run at a time.
PARALLEL = 3
RATIO = 2.0
#: Runs up to this size share the lowest tier.
SMALL_BYTES = 1 << 20
#: Bytes of text of an arrival that compacted() makes.
ARRIVAL_BYTES = 8 << 20
RETAIN_SECONDS = 7 * 24 * 3600


@dataclass(frozen=True)
class Run:
    files: tuple[str, ...]
    bytes: int
    rows: int


def tiers(runs: list[Run], small_bytes: int = SMALL_BYTES, ratio: float = RATIO) -> list[list[Run]]:
    """The runs by size, in tiers whose runs are of similar size."""
    out: list[list[Run]] = []
    total = 0
    for run in sorted(runs, key=lambda r: (r.bytes, r.files)):
        if out and run.bytes <= max(small_bytes, ratio * total / len(out[-1])):
            out[-1].append(run)
            total += run.bytes
        else:
            out.append([run])
            total = run.bytes
    return out


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # Versions ---------------------------------------------------------------------------------------

    def _path(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[tuple[int, int]]:
        """Number and time of commit (milliseconds) of each version."""
        folder, fs = self._path(f"{self.root}/versions")
        found = fs.listStatus(folder) if fs.exists(folder) else []
        return sorted((int(x.getPath().getName()), x.getModificationTime()) for x in found if x.getPath().getName().isdigit())

    def versions(self) -> list[int]:
        return [v for v, _ in self._listed()]

    def runs(self, version: int | None = None) -> list[Run]:
        """The live runs of a version, the latest by default."""
        known = self.versions()
        if not known:
            return []
        manifest, fs = self._path(f"{self.root}/versions/{known[-1] if version is None else version:08d}")
        stream = fs.open(manifest)
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
        return [Run(tuple(r["files"]), r["bytes"], r["rows"]) for r in map(json.loads, lines)]

    def _write_aside(self, runs: list[Run]) -> str:
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        path, fs = self._path(aside)
        stream = fs.create(path, False)
        try:
            stream.write("".join(json.dumps({"files": r.files, "bytes": r.bytes, "rows": r.rows}) + "\n" for r in runs).encode())
        finally:
            stream.close()
        return aside

    def _commit(self, base: int, runs: list[Run]) -> int:
        """Make runs the version after base; Conflict if that version exists."""
        jvm, aside = self.spark._jvm, self._path(self._write_aside(runs))[0]
        version, fs = self._path(f"{self.root}/versions/{base + 1:08d}")
        fs.mkdirs(version.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(version.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(aside, version, options)
        except Exception:
            if not fs.exists(version):
                raise
            fs.delete(aside, False)
            raise Conflict(base + 1) from None
        return base + 1

    def _change(self, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commit what change makes of the live runs, on whatever version is the latest; None if it makes nothing of them."""
        while True:
            base = (self.versions() or [0])[-1]
            runs = change(self.runs(base) if base else [])
            if runs is None:
                return None
            try:
                return self._commit(base, runs)
            except Conflict:
                continue

    # Rows -------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, rows_per_file: int = 0) -> list[Run]:
        """Write df; a run of its own for each file that has rows, by the files' names."""
        path = f"{self.root}/files/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        files = written.groupBy("file").agg(F.first("size").alias("size"), F.count("*").alias("n")).collect()
        return [Run((r["file"],), r["size"], r["n"]) for r in sorted(files, key=lambda r: r["file"])]

    def append(self, df: DataFrame, arrivals: int = 1, rows_per_file: int = 0) -> int | None:
        """Add df as one arrival, or as several; returns the version, None if df is empty.

        The files that the job's tasks write (of `rows_per_file` rows at most, if given) are dealt to arrivals of like
        numbers of files, in order."""
        files = self._write(df, rows_per_file)
        per = -(-len(files) // max(1, min(arrivals, len(files)))) if files else 1
        new = [_joined(files[at : at + per]) for at in range(0, len(files), per)]
        return self._change(lambda live: live + new) if new else None

    def read(self, version: int | None = None) -> DataFrame:
        files = [f for r in self.runs(version) for f in r.files]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def compact(self, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES) -> int:
        """Merge full tiers, smallest first, until there is none; returns how many merges were committed."""
        merges = 0
        while True:
            full = next((t for t in tiers(self.runs(), small_bytes) if len(t) >= fanout), None)
            if full is None:
                return merges
            groups = [full[at : at + fanout] for at in range(0, len(full) - fanout + 1, fanout)]
            with ThreadPoolExecutor(PARALLEL) as pool:
                merges += sum(pool.map(inheritable_thread_target(self.spark)(lambda group: self._merge(group, target_bytes)), groups))

    def _merge(self, group: list[Run], target_bytes: int) -> bool:
        """Merge runs into one and commit it; False if another writer has merged some of them meanwhile."""
        merged = self.spark.read.schema(self.schema).parquet(*[f for r in group for f in r.files])
        # Input splits are packed by size, so joining neighbours gives files of like size without a shuffle.
        n_files = max(1, -(-sum(r.bytes for r in group) // target_bytes))
        new, old = _joined(self._write(merged.coalesce(n_files))), set(group)
        return self._change(lambda live: [r for r in live if r not in old] + [new] if old <= set(live) else None) is not None

    def vacuum(self, retain_seconds: float = RETAIN_SECONDS) -> None:
        """Delete the versions that were replaced more than so many seconds ago, and files older than that which no
        other version lists."""
        listed = self._listed()
        before = self.spark._jvm.System.currentTimeMillis() - 1000 * retain_seconds
        gone = [v for (v, _), (_, replaced) in zip(listed, listed[1:]) if replaced <= before]
        kept = {f.rsplit("/", 1)[-1] for v, _ in listed if v not in gone for r in self.runs(v) for f in r.files}
        for version in gone:
            drop_scratch(self.spark, f"{self.root}/versions/{version:08d}")
        folder, fs = self._path(f"{self.root}/files")
        for job in fs.listStatus(folder) if fs.exists(folder) else []:
            files = fs.listStatus(job.getPath())
            # Files that a job in progress writes are newer; those of one that died are listed nowhere.
            if all(x.getModificationTime() <= before for x in [job, *files]) and not any(x.getPath().getName() in kept for x in files):
                fs.delete(job.getPath(), True)


def _joined(runs: list[Run]) -> Run:
    return Run(tuple(f for r in runs for f in r.files), sum(r.bytes for r in runs), sum(r.rows for r in runs))


def compacted(docs: DataFrame, arrival_bytes: int = ARRIVAL_BYTES, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """docs taken into a fresh store in small arrivals (of about so much text), compacted and read back."""
    store = ShardStore(docs.sparkSession, scratch(docs.sparkSession, "shards"), docs.schema)
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    arrivals = max(1, -(-n_bytes // arrival_bytes))
    store.append(docs, arrivals, max(1, -(-n_rows // arrivals)))
    store.compact(fanout, target_bytes, small_bytes)
    store.vacuum(0)  # nobody else has this store
    return store.read()
