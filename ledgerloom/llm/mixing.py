"""Mixing sources to target weights by fixed-length blocks.

The words of a source, document after document, are packed into blocks of `block_words` words. A source's
target is its weight's share of all words, bounded by `max_repeats` times its size; what that cuts off is
shared anew by weight. The target is turned into slots, one for each block to take: whole epochs over all
blocks of the source, then a part of one more. Slots are dealt over the output shards by independent
uniform draws, so that each shard's counts by source are multinomial given the sources' totals, which
meet the targets. Slot k of an epoch takes block p(k), where p is a pseudorandom permutation of the
source's block indices (swap-or-not over a hash, computed from the index alone), and slots are joined
with the documents' pieces of blocks by source and block index.

Everything is DataFrame functions. A source with a third of all rows is not gathered: documents are
packed in buckets of about `BUCKET_ROWS` rows by a hash of their id, running sums inside a bucket are
shifted by the sums of the buckets before, those again in groups, and slots are generated from chunks of
`CHUNK_SLOTS`, `TASK_SLOTS` to a task. Only the table of sources (one row each) is ordered as a whole.

Defined results: null or empty text has size 0 and is never taken; a null source is one source of its
own, last in order; repeated rows are packed one after the other; rows with equal id and size may swap
their places, which changes nothing in the result; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, materialise, wrapped

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
SHARDS = 64
BUCKET_ROWS = 400
CHUNK_SLOTS = 4096
TASK_SLOTS = 1 << 16
ROUNDS = 16
SEED = 20240607


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From one row per source (source, source_size) the rank, weight and target (double) of each.

    Sources fill up in the order of size over weight: once a source is not cut off by its bound at the
    share that is left, no later one is, so running sums find the level. Empty sources get 0."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(order)).withColumn("weight", weight)
    bound = F.col("source_size") * F.lit(float(max_repeats))
    ranked = ranked.withColumn("bound", bound).withColumn("ratio", F.col("bound") / F.col("weight"))
    by_ratio, everything = Window.orderBy("ratio", "source_rank"), Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", left / weight_left)
    # The level at the first source that its bound does not cut off holds for it and all later ones.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_rank", "level"))).over(everything)["level"]
    return levelled.withColumn("final", level).select(
        "source", "source_size", "source_rank", F.least("bound", F.col("weight") * F.coalesce("final", F.lit(0.0))).alias("target")
    )


def _permuted(index: Column, n: Column, salt: Column, seed: int, inverse: bool = False) -> Column:
    """Image of index under a pseudorandom permutation of 0..n-1: each round swaps pairs that mirror each other, or doesn't.

    A round undoes itself, so the rounds in reverse order give the inverse."""
    def one_round(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(salt, r, F.lit(seed)), n) - x, n)
        swap = F.pmod(F.xxhash64(salt, r, F.greatest(x, mirror), F.lit(seed + 1)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, index.cast("long"), one_round)


def running_sums(df: DataFrame, value: str, path: list[str], order: list) -> DataFrame:
    """df with `before`: the sum of `value` over the rows that come earlier with the same path[0] (long columns, no nulls).

    Rows are ordered by the rest of the path, then by `order`. No window is wider than the rows of one path, or the
    distinct values of one part of it under the parts before: sums of each level shift the level below."""
    inside = Window.partitionBy(*path).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    finest = materialise(df.groupBy(*path).agg(F.sum(value).alias("_sum")), "running-sums")
    shifts = None
    for depth in range(1, len(path)):
        keys = path[: depth + 1]
        sums = finest if depth == len(path) - 1 else finest.groupBy(*keys).agg(F.sum("_sum").alias("_sum"))
        level = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
        own = sums.select(*keys, (F.sum("_sum").over(level) - F.col("_sum")).alias("_own"))
        shifts = own.withColumnRenamed("_own", "_shift") if shifts is None else own.join(shifts, keys[:-1]).select(*keys, (F.col("_own") + F.col("_shift")).alias("_shift"))
    return rows.join(shifts, path).select(*df.columns, (F.col("_inside") + F.col("_shift")).alias("before"))


def _packed(sized: DataFrame, n_rows: int) -> DataFrame:
    """Appends `begin`, the words of the source before each row in packing order."""
    n_buckets = max(1, n_rows // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "size", "row_hash"), F.lit(n_buckets))
    placed = sized.withColumns({"_source": _key("source"), "_bucket": bucket}).withColumn("_group", F.floor(F.col("_bucket") / math.isqrt(n_buckets)).cast("long"))
    sums = running_sums(placed, "size", ["_source", "_group", "_bucket"], ["doc_id", "size", "row_hash"])
    return sums.withColumnRenamed("before", "begin").drop("_source", "_group", "_bucket")


def _key(source: str) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _slots(targets: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per slot: source, shard, slot, epoch, block, and how many words of the block it takes."""
    size, target = F.col("source_size"), F.round("target").cast("long")
    per_source = targets.where((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        F.col("source").alias("s_source"), F.col("source_rank").cast("long").alias("salt"), size.alias("s_size"),
        F.ceil(size / F.lit(block_words)).cast("long").alias("n_blocks"), target.alias("words"),
    )
    n_slots = F.ceil(F.col("words") / F.col("s_size")).cast("long") * F.col("n_blocks")
    # The planner sees few small rows here, whatever the number of slots they stand for.
    n_tasks = -(-(per_source.agg(F.coalesce(F.sum(n_slots), F.lit(0))).first()[0]) // TASK_SLOTS)
    chunks = per_source.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), (n_slots - 1)).cast("long"), F.lit(CHUNK_SLOTS).cast("long"))).alias("first")).repartition(max(1, n_tasks), "salt", "first")
    slots = chunks.select("*", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK_SLOTS, n_slots) - 1)).alias("slot"))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")).cast("long")).withColumn("k", F.col("slot") % F.col("n_blocks"))
    slots = slots.withColumn("block", _permuted(F.col("k"), F.col("n_blocks"), F.xxhash64("salt", "epoch"), seed))
    # Words of the epoch before this slot: whole blocks, but that the short last block may be among them.
    short = F.col("n_blocks") * block_words - F.col("s_size")
    slots = slots.withColumn("short_at", _permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.xxhash64("salt", "epoch"), seed, inverse=True))
    before = F.col("k") * block_words - F.when(F.col("short_at") < F.col("k"), short).otherwise(F.lit(0))
    full = F.lit(block_words) - F.when(F.col("block") == F.col("n_blocks") - 1, short).otherwise(F.lit(0))
    take = F.least(full, F.col("words") - F.col("epoch") * F.col("s_size") - before)
    shard = F.pmod(F.xxhash64("salt", "slot", F.lit(seed + 2)), F.lit(SHARDS))
    return slots.select("s_source", shard.alias("shard"), "slot", "epoch", "block", take.alias("take")).where("take > 0")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of docs: a row per document (doc_id, row_hash, size, source, source_size, target, begin), and the
    manifest: for each piece of a document that a slot takes its shard, slot, epoch, source, block, doc_id,
    row_hash and first and last word in the document (end exclusive). row_hash tells rows of one id apart."""
    sized = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row_hash"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
    ), "mix-sizes")
    n_rows = sized.count()
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "mix-targets")
    named = targets.withColumnRenamed("source", "_source")
    packed = _packed(sized, n_rows)
    documents = packed.join(F.broadcast(named) if named.count() <= 10_000 else named, packed["source"].eqNullSafe(F.col("_source")), "left").drop("_source", "source_rank")
    documents = materialise(documents, "mix-documents")
    pieces = documents.where("size > 0").select(
        "*", F.explode(F.sequence(F.floor(F.col("begin") / block_words).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block_words).cast("long"))).alias("p_block")
    )
    slots = _slots(targets, block_words, seed)
    # The planner can't see how many slots a source gets: never broadcast them.
    joined = pieces.join(slots.hint("merge"), pieces["source"].eqNullSafe(slots["s_source"]) & (pieces["p_block"] == slots["block"]))
    # A slot takes the first `take` words of its block.
    start = F.greatest(F.col("begin"), F.col("block") * block_words)
    end = F.least(F.col("begin") + F.col("size"), F.col("block") * block_words + F.col("take"))
    manifest = joined.where(end > start).select(
        "shard", "slot", "epoch", "source", "block", "doc_id", "row_hash", "begin", (start - F.col("begin")).alias("first"), (end - F.col("begin")).alias("last")
    )
    return documents, manifest


def taken_by_document(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """documents with `taken`, the words that the mix takes of each, repeats counted."""
    key = ["source", "begin", "doc_id", "row_hash"]
    sums = manifest.groupBy(*key).agg(F.sum(F.col("last") - F.col("first")).alias("_taken"))
    # Rows without words share their place with the next row; they are never taken.
    right = sums.select(*[F.col(c).alias(f"_{c}") for c in key], "_taken")
    on = [documents[c].eqNullSafe(right[f"_{c}"]) for c in key] + [documents["size"] > 0]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return documents.join(right, condition, "left").select(*documents.columns, F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


#: A share's fraction in whole numbers.
_PARTS = 1 << 30


def copies(taken: DataFrame, seed: int = SEED) -> DataFrame:
    """From taken_by_document: whole copies of each document (doc_id, row_hash, source, copies), one row for equal ones.

    A document of share x is taken floor(x) times or once more. Whose fraction rounds up follows from a running sum of
    the fractions over the source's documents, the largest first: one more each time that the sum passes a whole
    number. So the words of a source are off from what the mix takes by less than its largest document, at any length
    of documents. Rows of equal id, source and text can't be told apart; they count as one document with all of
    their words and get their mean share each."""
    alike = taken.where("size > 0").groupBy("doc_id", "row_hash", "source").agg(
        F.avg(F.col("taken") / F.col("size")).alias("times"), F.sum("size").alias("words")
    )
    whole = F.floor("times")
    shares = materialise(alike.select("doc_id", "row_hash", "source", "words", whole.cast("int").alias("whole"), F.round((F.col("times") - whole) * _PARTS).cast("long").alias("part")), "mix-shares")
    open_ = shares.where("part > 0").withColumns({
        "_source": _key("source"), "_size": -F.col("words"), "_draw": F.xxhash64("doc_id", "row_hash", "source", F.lit(seed + 3)),
    })
    n_buckets = max(1, open_.count() // BUCKET_ROWS)
    bucket = F.pmod("_draw", F.lit(n_buckets))
    placed = open_.withColumn("_bucket", bucket).withColumn("_group", F.floor(F.col("_bucket") / math.isqrt(n_buckets)).cast("long"))
    summed = running_sums(placed, "part", ["_source", "_size", "_group", "_bucket"], ["_draw", "doc_id", "row_hash"])
    offset = F.pmod(F.xxhash64("_source", F.lit(seed + 4)), F.lit(_PARTS))
    more = F.floor((F.col("before") + F.col("part") + offset) / _PARTS) - F.floor((F.col("before") + offset) / _PARTS)
    both = summed.select("doc_id", "row_hash", "source", (F.col("whole") + more).cast("int").alias("copies")).union(
        shares.where("part = 0").select("doc_id", "row_hash", "source", F.col("whole").alias("copies"))
    )
    return both.where("copies > 0")


def apply_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, **options) -> DataFrame:
    """docs' rows with each document repeated as often as the mix takes it, in whole copies (see copies()); columns stay,
    whatever their names. Rows without words are never taken."""
    documents, manifest = mix(docs, block_words=block_words, seed=seed, **options)
    n = copies(taken_by_document(documents, manifest), seed)
    row = wrapped(docs, key_id=F.col("doc_id").cast("long"), key_text=F.coalesce(F.xxhash64("text"), F.lit(0)), key_source=F.col("source").cast("string"))
    on = row["key_id"].eqNullSafe(n["doc_id"]) & (row["key_text"] == n["row_hash"]) & row["key_source"].eqNullSafe(n["source"])
    return row.join(n, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k")).select("row.*")
