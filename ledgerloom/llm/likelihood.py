"""Language-model scores: the marginal likelihood of a text over all its segmentations into subwords.

The vocabulary is an existing one; its pieces get unigram probabilities from the training documents: the
training words are counted, cut into pieces by the vocabulary's own library, and the pieces' counts
smoothed. A word's probability is the sum over all ways to cut it into pieces, by a forward recursion in
log space over the lattice; characters that are no piece go through the byte pieces. Pieces never cross
white space, so a document's likelihood is the product over its words and its end.

Words are the unit of work: each distinct word is counted once and its lattice run once, however often it
occurs. The most frequent words, `FREQUENT_WORDS` at most, go to the executors with their scores; the
others are joined by word, after counting them per document. Piece counts are at most one row per piece
of the vocabulary.

Defined results: null or empty text has the end token alone; a null id is never held out; rows that
repeat both id and text get equal rows; an empty table gives an empty result; without any training
document all counts are 0 and pieces are uniform. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, most_frequent, utf8

FREQUENT_WORDS = 150_000
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 300_000
_LN10 = math.log(10)


def held_out(doc_id):
    """crc32 of the id as text leaves remainder 2 by 7."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _count_words(frame: DataFrame) -> DataFrame:
    """word, c: how often each word of any document occurs in training documents."""
    def count(batches):
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in arrow_batches(batches):
            for text, out in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                if out:
                    counts.update(dict.fromkeys(words, 0))
                else:
                    counts.update(words)
                if len(counts) > HELD_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return frame.select("text", "held_out").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _piece_counts(words: DataFrame, model_path: str) -> dict[int, int]:
    """How often each piece occurs in the training words; one row per piece of the vocabulary at most."""
    def cut(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        total = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in arrow_batches(batches):
            pieces = model.encode([w.decode() for w in batch.column(0).to_pylist()], num_threads=1)
            lengths = [len(p) for p in pieces]
            flat = np.fromiter((x for p in pieces for x in p), dtype=np.int64, count=sum(lengths))
            np.add.at(total, flat, np.repeat(batch.column(1).to_numpy(), lengths))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    rows = words.where("c > 0").mapInArrow(cut, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def piece_scores(model_path: str, counts: dict[int, int], n_documents: int) -> tuple[dict[str, float], list[float], float]:
    """Natural logs of probability: by piece, by byte (byte pieces), and of the end. Add-one smoothing over all of them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    total = math.log(sum(counts.values()) + n_documents + n + 1)
    score = [math.log(counts.get(i, 0) + 1) - total for i in range(n)]
    pieces = {model.id_to_piece(i): score[i] for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return pieces, [score[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)], math.log(n_documents + 1) - total


def forward(word: str, pieces: dict[str, float], by_byte: list[float], longest: int) -> float:
    """Natural log of the probability of a word, all segmentations together."""
    text = "▁" + word
    alpha = [0.0] + [-math.inf] * len(text)
    for i in range(1, len(text) + 1):
        terms = []
        for j in range(max(0, i - longest), i):
            score = pieces.get(text[j:i])
            if score is None and j == i - 1:
                score = sum(by_byte[b] for b in text[j].encode())
            if score is not None:
                terms.append(alpha[j] + score)
        most = max(terms)
        alpha[i] = most + math.log(sum(math.exp(t - most) for t in terms)) if len(terms) > 1 else most
    return alpha[-1]


def _score_words(words: DataFrame, model) -> DataFrame:
    """words with lp, log10 of each word's probability."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces, by_byte, _ = shared.value
        longest = max(map(len, pieces))
        for batch in arrow_batches(batches):
            lp = [forward(w.decode(), pieces, by_byte, longest) / _LN10 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp, pa.float64())], ["word", "c", "lp"])

    return words.mapInArrow(run, "word binary, c long, lp double")


def _by_document(frame: DataFrame, frequent: dict[bytes, tuple[float, float, int]]) -> DataFrame:
    """A row per document with the sums over its frequent words, and one for each other word in it.

    Documents' rows have a word of their own with a space in it, which joins with nothing and spreads them."""
    shared = frame.sparkSession.sparkContext.broadcast(frequent)
    names = ["doc_id", "text_hash", "word", "n", "n_tokens", "n_known", "base", "score"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def split(batches):
        known = shared.value
        for batch in arrow_batches(batches):
            rows: list[list] = [[] for _ in names]

            def put(*row):
                for column, value in zip(rows, row, strict=True):
                    column.append(value)

            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.lower().split()
                n_known, base, score = 0, 0.0, 0.0
                for word, n in Counter(words).items():
                    if (found := known.get(word)) is None:
                        put(doc_id, text_hash, word, n, None, None, None, None)
                    else:
                        base, score, n_known = base + n * found[0], score + n * found[1], n_known + n * found[2]
                put(doc_id, text_hash, b"%d %d" % (doc_id or 0, text_hash), None, len(words), n_known, base, score)
                if len(rows[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    schema = "doc_id long, text_hash long, word binary, n long, n_tokens long, n_known long, base double, score double"
    return frame.select("doc_id", "text_hash", "text").mapInArrow(split, schema)


def score(docs: DataFrame, model_path: str, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    doc_id = F.col("doc_id").cast("long")
    frame = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(doc_id).alias("held_out"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    counted = materialise(_count_words(frame), "lm-counts")
    ends = frame.agg(F.count_if(~F.col("held_out"))).first()[0]
    n_words, n_distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train, distinct = n_words + ends, n_distinct + (ends > 0)
    model = piece_scores(model_path, _piece_counts(counted, model_path), ends)
    scored = materialise(_score_words(counted, model), "lm-words")

    denominator = math.log10(train + distinct + 1)
    top = most_frequent(scored, "c", frequent_words).collect()
    frequent = {bytes(r["word"]): (math.log10(r["c"] + 1) - denominator, r["lp"], int(r["c"] > 0)) for r in top}
    rows = _by_document(frame, frequent)
    # A word that repeats within equal rows (same id, same text) counts once for them; the row count is `copies`.
    w = scored.select(F.col("word").alias("w"), "c", "lp")
    joined = rows.join(w, rows["word"] == w["w"], "left")
    rare_base = F.log10(F.col("c") + 1) - F.lit(denominator)
    sums = joined.groupBy("doc_id", "text_hash").agg(
        F.count("n_tokens").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(F.col("n") * rare_base), F.lit(0.0))).alias("base"),
        (F.sum("score") + F.coalesce(F.sum(F.col("n") * F.col("lp")), F.lit(0.0))).alias("score"),
    )
    end_base, end_score = math.log10(ends + 1) - denominator, model[2] / _LN10
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), (F.col("n_tokens") / F.col("copies") + 1).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies") + int(ends > 0)).cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + end_base).alias("base_score"), (F.col("score") / F.col("copies") + end_score).alias("score"),
    )
