"""A training-data pipeline over documents.

Every stage takes any columns beside those it reads, whatever their names, returns docs' columns, and gives an empty
table for an empty one. Long texts are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, jaccard, mixing, quality, sharding
from ledgerloom.llm.common import scratch, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go.

    Rows are judged one by one, so equal rows stay or go together. Null, empty and blank texts fail and go; a null lang has
    no reference for its words, which are not judged then. There are no ties."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row of each group of linked documents stays.

    It is the one of the smallest id, null ids last; of equal ids the text of the smaller hash, and of rows equal in both any
    one, so repeated rows stay once. Null, empty and blank texts are in no group and all stay."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go.

    Rows are judged one by one, so equal rows stay or go together. Null and empty texts have no words and stay, as does
    everything beside an empty benchmark. There are no ties."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document comes as often as the mix takes it, rounded up or down so that the
    words of a source are off its target by less than its largest document.

    A null source is a source of its own, last in order. Null, empty and blank texts have no words to take and go. Rows equal
    in id, source and text are taken alike; ties are decided by hashes, so reruns agree."""
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the rows go into a store in small arrivals, which is compacted; what its last version holds.

    All rows come back as they are: nulls, empty texts and repeated rows with them. Nothing is decided, so there are no ties."""
    return sharding.compacted(docs)


STAGES = [
    ("quality", good_documents),
    ("near_copies", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Stages run Python operators; the tests hold run() against a brute-force version.
ORACLE_SQL = None
