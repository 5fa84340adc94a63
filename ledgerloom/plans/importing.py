"""Import, replay and table updates: sources' records into a store of fingerprinted rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.identity import known_by_fingerprint, occurrence_index, set_difference, with_fingerprint
from ..schema import ACCOUNT_NATURES, ACCOUNT_TYPES, CATEGORY_KINDS, RECORD

STORED = "raw_description string, raw_amount long, currency string, raw_date date, account_id long, line_number int, occurrence_index int, fingerprint string, batch_id string"


class RecordStore:
    """Rows in a folder, one sub-folder per batch. A batch is written aside and then renamed, so it is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        folder, fs = self._fs(f"{self.root}/batches")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(f"{self.root}/batches")

    def add(self, rows: DataFrame, batch_id: str) -> None:
        staged, fs = self._fs(f"{self.root}/staged/{batch_id}")
        rows.withColumn("batch_id", F.lit(batch_id)).write.parquet(f"{self.root}/staged/{batch_id}")
        final, _ = self._fs(f"{self.root}/batches/{batch_id}")
        fs.mkdirs(final.getParent())
        if not fs.rename(staged, final):
            raise OSError(f"batch {batch_id} could not be published")


@dataclass(frozen=True)
class ImportReport:
    batch_id: str
    record_count: int
    created: int
    duplicated: int
    failed: int
    status: str


def identified(records: DataFrame) -> DataFrame:
    """Normalised records with occurrence index and fingerprint."""
    rows = records.select(
        F.col("description").alias("raw_description"), F.col("amount_minor").alias("raw_amount"), "currency", F.col("booked_date").alias("raw_date"), "account_id", "line_number"
    )
    return with_fingerprint(occurrence_index(rows, order=("line_number", "raw_description")))


def import_records(store: RecordStore, records: DataFrame, dry_run: bool = False) -> ImportReport:
    """Add the records that the store doesn't know. Rows without account, date or amount fail and are counted."""
    bad = F.col("account_id").isNull() | F.col("booked_date").isNull() | F.col("amount_minor").isNull()
    counts = records.agg(F.count("*").alias("n"), F.count_if(bad).alias("failed")).first()
    batch_id = uuid.uuid4().hex
    if dry_run:
        return ImportReport(batch_id, counts.n, 0, 0, counts.failed, "dry_run")
    fresh = known_by_fingerprint(identified(records.where(~bad)), store.read(), known=False)
    store.add(fresh.select("raw_description", "raw_amount", "currency", "raw_date", "account_id", "line_number", F.col("occurrence_index").cast("int").alias("occurrence_index"), "fingerprint"), batch_id)
    created = store.spark.read.parquet(f"{store.root}/batches/{batch_id}").count()
    duplicated = counts.n - counts.failed - created
    status = "failed" if counts.n == 0 else "completed" if created + duplicated == counts.n else "partial"
    return ImportReport(batch_id, counts.n, created, duplicated, counts.failed, status)


def replay_difference(store: RecordStore, parsed: DataFrame) -> DataFrame:
    """How a new parse of the archived input differs from what is stored; all zero if a replay may go on."""
    return set_difference(parsed, store.read())


ARCHIVE = "path string, checksum string, payload string"
#: What a payload that can't be restored is told to be.
NO_PAYLOAD, NOT_BASE64, NOT_GZIP, NOT_THE_CONTENT = "no payload", "payload is not base64", "payload is not gzip", "content differs from its checksum"


#: Bytes of contents or payloads that a worker handles at once, beside one row that may be larger.
SLICE_BYTES = 4 << 20


def _slices(batches, column: int, limit: int | None = None):
    """Batches cut into slices of about SLICE_BYTES in a column: a batch has thousands of rows, whatever their size."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def archived(files: DataFrame) -> DataFrame:
    """path, checksum, payload of files (path, content): the content gzipped, as base64, with the SHA-256 of what it was.

    The time in the header is fixed, so that the same file gives the same payload again. Files go through in slices of Arrow
    batches, so that a worker holds a few megabytes beside the batch."""
    def pack(batches):
        for batch in _slices(batches, 1):
            paths, contents = (c.to_pylist() for c in batch.columns)
            payloads = [None if c is None else base64.b64encode(gzip.compress(c, mtime=0)).decode() for c in contents]
            sums = [None if c is None else hashlib.sha256(c).hexdigest() for c in contents]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, sums, payloads)], ["path", "checksum", "payload"])

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(pack, ARCHIVE)


def restored(archive: DataFrame) -> DataFrame:
    """path, content, error of an archive: the content, or null and why there is none."""
    def unpack(checksum: str | None, payload: str | None) -> tuple[bytes | None, str | None]:
        if payload is None:
            return None, NO_PAYLOAD
        try:
            packed = base64.b64decode(payload, validate=True)
        except ValueError:
            return None, NOT_BASE64
        try:
            content = gzip.decompress(packed)
        except (OSError, EOFError, zlib.error):
            return None, NOT_GZIP
        return (content, None) if hashlib.sha256(content).hexdigest() == checksum else (None, NOT_THE_CONTENT)

    def read(batches):
        for batch in _slices(batches, 2):
            paths, sums, payloads = (c.to_pylist() for c in batch.columns)
            done = [unpack(s, p) for s, p in zip(sums, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([c for c, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["path", "content", "error"])

    return archive.select("path", "checksum", "payload").mapInArrow(read, "path string, content binary, error string")


def patched(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the non-null fields of changes, row by row."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    return table.join(c, key, "left").select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in fields else F.col(x) for x in table.columns])


def without(table: DataFrame, gone: DataFrame, key: str = "id", on: str | None = None) -> DataFrame:
    """table less the rows of gone; with `on`, less the rows whose column points at them (a cascade)."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    return table.join(keys, table[on or key] == keys["_gone"], "left_anti")


def looked_up(table: DataFrame, wanted: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of table with the wanted keys, and the wanted keys that it doesn't have."""
    keys = wanted.select(F.col(key)).distinct()
    return table.join(keys, key, "left_semi").select(table.columns), keys.join(table.select(key), key, "left_anti")


def created(table: DataFrame, rows: DataFrame, unique: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """table with new rows (without a key), and the rows that are refused as their `unique` column is taken.

    Keys go on from the largest; rows get them in the order of the unique column."""
    value = F.lower(F.trim(F.col(unique)))
    taken = table.select(value.alias("_taken")).distinct()
    repeated = F.row_number().over(Window.partitionBy(value).orderBy(unique)) > 1
    judged = rows.withColumn("_again", repeated).join(taken, value == F.col("_taken"), "left").withColumn("_refused", F.col("_again") | F.col("_taken").isNotNull())
    last = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    fresh = judged.where("not _refused").withColumn(key, (F.lit(last) + F.row_number().over(Window.orderBy(unique))).cast("long"))
    return table.unionByName(fresh.select([c for c in table.columns if c in fresh.columns]), allowMissingColumns=True), judged.where("_refused").select(rows.columns)


def _added(table: DataFrame, rows: DataFrame, unique: list[str], reason: Column) -> tuple[DataFrame, DataFrame]:
    """table with the rows that have no reason against them and whose `unique` columns are not taken, by the table or an earlier
    row; and the refused rows with their reason. Nulls of `unique` count as equal."""
    value = F.struct(*unique)
    taken = table.select(value.alias("_taken")).distinct()
    judged = rows.withColumn("reason", reason).join(taken, value.eqNullSafe(F.col("_taken")), "left")
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("_taken").isNotNull(), TAKEN))).drop("_taken")
    again = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), *unique).orderBy(*[c for c in rows.columns if c not in unique] or unique)) > 1
    judged = judged.withColumn("_again", again).withColumn("reason", F.coalesce("reason", F.when(F.col("_again"), TAKEN))).drop("_again")
    last = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # Unique, as a database's sequence is; gaps may be left.
    fresh = judged.where("reason is null").withColumn("id", F.lit(last) + 1 + F.monotonically_increasing_id())
    return table.unionByName(fresh.select([c for c in table.columns if c in fresh.columns]), allowMissingColumns=True), judged.where("reason is not null")


TAKEN = "name is taken"


def _named(column: str, table: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """rows with _there: whether the table has what the column names, true where it names nothing."""
    known = table.select(F.col(key).alias("_key")).distinct()
    return rows.join(known, rows[column] == F.col("_key"), "left").withColumn("_there", F.col(column).isNull() | F.col("_key").isNotNull()).drop("_key")


def with_accounts(accounts: DataFrame, rows: DataFrame, currencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accounts with new ones, and those that are refused: type, nature or currency (code) must be known."""
    there = _named("currency", currencies, "code", rows)
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    reason = F.when(outside("account_type", ACCOUNT_TYPES), "unknown account type").when(outside("account_nature", ACCOUNT_NATURES), "unknown account nature").when(~F.col("_there") | F.col("currency").isNull(), "unknown currency")
    # Accounts may share a name: nothing of theirs is unique.
    judged = there.withColumn("reason", reason).drop("_there")
    last = accounts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = judged.where("reason is null").withColumn("id", F.lit(last) + 1 + F.monotonically_increasing_id())
    return accounts.unionByName(fresh.select([c for c in accounts.columns if c in fresh.columns]), allowMissingColumns=True), judged.where("reason is not null")


def with_categories(categories: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """categories with new ones (parent_id, name, kind), and those that are refused: of an unknown kind, under no such parent, or
    of a name that the parent has."""
    there = _named("parent_id", categories, "id", rows)
    reason = F.when(~F.coalesce(F.col("kind").isin(*CATEGORY_KINDS), F.lit(False)), "unknown kind").when(~F.col("_there"), "no such parent")
    table, refused = _added(categories, there, ["parent_id", "name"], reason)
    return table, refused.drop("_there")


def with_merchants(merchants: DataFrame, rows: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merchants with new ones (name, category_id), and those that are refused: filed under no such category, or of a taken name."""
    table, refused = _added(merchants, _named("category_id", categories, "id", rows), ["name"], F.when(~F.col("_there"), "no such category"))
    return table, refused.drop("_there")


def transactions_without(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Transactions are never deleted."""
    raise ValueError("transactions are not deleted; void or recategorise them")
