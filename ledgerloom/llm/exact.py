"""Exact duplicates by a persistent index of digests.

The index is a Parquet table of the digests of all texts that were ever kept, bucketed and sorted by digest. New documents
are hashed where they are, reduced to one row for each distinct digest, and joined to the index by a sort-merge anti-join:
the index's buckets are read as they are, only digests of the arrival are shuffled. What the join leaves is new and is
appended to the buckets. An arrival counts once its number is published by a rename (`commits/`); rows that a writer left
that died before, or that lost the race for a number, belong to no published arrival and are not read.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space. Of equal texts of one arrival the row of
the smallest id stays; a text that an earlier arrival has stays there. deduplicate() takes a table in as arrivals by ranges of
ids, so that the smallest id of all stays.

A group of copies of any size costs one row an arrival in the index. Digests that over a thousandth of the rows have (fewer
than a thousand, by counting) are joined to rows by a broadcast, the others by their digest.

Defined results: null and empty texts are equal to each other, one group; a null id is larger than all others; of rows equal
in id and text one stays, any; an empty table gives an empty result and adds no arrival; texts are hashed whole; other columns
of any name come back unchanged.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_end, hadoop_path, materialise, publish, read_text, scratch, wrapped

#: Digests of a bucket at which a new index has another.
BUCKET_ROWS = 2_000_000
#: A digest that more than one in so many rows have is joined by a broadcast.
HEAVY_SHARE = 1000
#: Arrivals that deduplicate() makes of a table.
ARRIVALS = 4
_ENTRY = "digest BINARY, arrival STRING, doc_id LONG, row LONG"


def digest(text: Column) -> Column:
    """SHA-256 of the text with runs of blanks as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, and a number of each row that stays as it is."""
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


class DigestIndex:
    """An index in a folder; created by create(), found again by open()."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int) -> None:
        self.spark, self.root, self.n_buckets = spark, root, n_buckets
        self.table = f"ledgerloom_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({_ENTRY}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{root}/entries'")
        at_end(spark, lambda: spark.sql(f"DROP TABLE IF EXISTS {self.table}"))

    @classmethod
    def create(cls, spark: SparkSession, root: str, expected: int = 0) -> DigestIndex:
        """A new index for about so many digests; rebucketed() changes the number of buckets later."""
        n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET_ROWS))
        if not publish(spark, json.dumps({"buckets": n_buckets}), f"{root}/layout", f"{root}/aside"):
            raise FileExistsError(root)
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> DigestIndex:
        return cls(spark, root, json.loads(read_text(spark, f"{root}/layout"))["buckets"])

    def arrivals(self) -> list[str]:
        """The names of the published arrivals, in order."""
        folder, fs = hadoop_path(self.spark, f"{self.root}/commits")
        numbers = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
        return [read_text(self.spark, f"{self.root}/commits/{n}") for n in numbers]

    def entries(self, arrivals: list[str] | None = None) -> DataFrame:
        """digest, arrival, doc_id, row of each text that stays; of given arrivals only, if any are given."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).where(F.col("arrival").isin(self.arrivals() if arrivals is None else arrivals))

    def add(self, hashed: DataFrame) -> str | None:
        """Take in the rows of digests() (doc_id, digest, row) as an arrival; its name, None if there are no rows."""
        first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        groups = hashed.groupBy("digest").agg(F.min(first).alias("first"))
        if hashed.isEmpty():
            return None
        while True:
            known, name = self.arrivals(), uuid.uuid4().hex
            fresh = groups.join(self.entries(known).select("digest").hint("merge"), "digest", "left_anti") if known else groups
            rows = fresh.select("digest", F.lit(name).alias("arrival"), "first.doc_id", "first.row")
            # Dealt as buckets are, each bucket gets one file.
            rows.repartition(self.n_buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
            if publish(self.spark, name, f"{self.root}/commits/{len(known):08d}", f"{self.root}/aside"):
                return name

    def rebucketed(self, root: str, expected: int) -> DigestIndex:
        """A copy in another folder, with buckets for so many digests, one sorted file each."""
        copy = DigestIndex.create(self.spark, root, expected)
        known = self.arrivals()
        self.entries(known).repartition(copy.n_buckets, "digest").sortWithinPartitions("digest").write.insertInto(copy.table)
        for number, name in enumerate(known):
            publish(self.spark, name, f"{root}/commits/{number:08d}", f"{root}/aside")
        return copy

    def new_documents(self, docs: DataFrame) -> DataFrame:
        """Take docs in as an arrival; the rows of docs that stay."""
        held = materialise(wrapped(docs, doc_id=F.col("doc_id").cast("long"), digest=digest(F.col("text")), number=F.monotonically_increasing_id()), "arrival")
        arrival = self.add(held.select("doc_id", "digest", F.col("number").alias("row")))
        kept = self.entries([arrival] if arrival else []).select(F.col("row").alias("number"))
        return held.join(kept, "number", "left_semi").select("row.*")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, arrivals: int = ARRIVALS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, taken into an index (a fresh one by default) by
    ranges of doc_id. group_size counts the rows of docs."""
    spark = docs.sparkSession
    hashed = digests(docs)
    n_rows = hashed.count()
    index = index or DigestIndex.create(spark, scratch(spark, "digest-index"), n_rows)
    bounds = sorted(set(hashed.approxQuantile("doc_id", [k / arrivals for k in range(1, arrivals)], 0.01)))
    # Null ids are the largest.
    part = sum(((F.col("doc_id") > b) | F.col("doc_id").isNull()).cast("int") for b in bounds) if bounds else F.lit(0)
    names = [index.add(hashed.where(part == k)) for k in range(len(bounds) + 1)]
    arrival = F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), part + 1)

    sizes = hashed.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = sizes.join(index.entries().select("digest", F.col("arrival").alias("kept_in"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")), "digest")
    groups = materialise(groups, "digest-groups")
    heavy = groups.where(F.col("group_size") * HEAVY_SHARE > n_rows)
    rows = hashed.withColumn("arrival", arrival)
    # Heavy groups are found by the broadcast; what it leaves is joined by digest.
    rows = rows.join(F.broadcast(heavy.select("digest", F.struct("group_size", "kept_in", "keep_id", "keep_row").alias("found"))), "digest", "left")
    light = rows.where("found is null").drop("found").join(groups.where(F.col("group_size") * HEAVY_SHARE <= n_rows), "digest")
    columns = ["doc_id", "keep_id", "group_size", ((F.col("kept_in") == F.col("arrival")) & (F.col("keep_row") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return rows.where("found is not null").select("*", "found.*").select(*columns).union(light.select(*columns))


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS h FROM documents)
WINDOW w AS (PARTITION BY h)
"""
