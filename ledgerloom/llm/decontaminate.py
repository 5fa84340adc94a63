"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items are lower-cased (A-Z), cut into words and turned into windows of `ngram` words; an item with
fewer words is one window. All windows of a block of items go into one automaton, and each document
is normalised and scanned once. Hits come back as word positions and as code-point offsets in the
original text.

The items go to every executor. Their size is measured first: items beyond `block_bytes` are dealt
into blocks of about that size, and the documents pass through one automaton after the other, so no
automaton grows with the benchmark. Nothing is shuffled.

Defined results: null or empty text has no words and no hits; a null item text has no windows; a null
item_id is listed as `null`; repeated documents and repeated items are treated row by row (an item id
counts once); an empty benchmark hits nothing. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, utf8

NGRAM = 13
BLOCK_BYTES = 16 << 20

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# ASCII bytes that are no digit and no letter separate words; bytes of 0x80 and more belong to words.
_NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_MARK_SCHEMA = (
    "n_words long, n_hit long, items array<string>, "
    "word_spans array<struct<first:int,last:int>>, char_spans array<struct<start:int,end:int>>"
)
_MARK_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("word_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ("char_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])

#: The automaton of the last broadcast a worker used; blocks are scanned one after the other.
_built: tuple[str, ahocorasick.Automaton] | None = None


def normalise(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.translate(_NORMAL).split()


def windows(text: bytes, ngram: int = NGRAM) -> list[bytes]:
    """The windows of an item, words joined by one space."""
    words = normalise(text)
    if not words:
        return []
    return [b" ".join(words[i : i + ngram]) for i in range(max(1, len(words) - ngram + 1))]


def _automaton(key: str, patterns: list[tuple[bytes, int, list[str]]]) -> ahocorasick.Automaton:
    global _built
    if _built is None or _built[0] != key:
        _built = None
        automaton = ahocorasick.Automaton()
        for window, n_words, items in patterns:
            automaton.add_word(f" {window.decode('latin-1')} ", (n_words, items))
        automaton.make_automaton()
        _built = key, automaton
    return _built[1]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(automaton, text: bytes, spans: list[tuple[int, int]], items: set[str]):
    """Words, runs of hit words (earlier ones included), items found, and the runs in the original text."""
    words = normalise(text)
    padded = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(padded.decode("latin-1"))) if words and len(automaton) else []
    if not found and not spans:
        return len(words), 0, [], items, []
    hit = np.zeros(len(words), dtype=bool)
    for first, last in spans:
        hit[first : last + 1] = True
    spaces = np.cumsum(np.frombuffer(padded, dtype=np.uint8) == 0x20)
    for at, (n, ids) in found:
        end = int(spaces[at]) - 1
        hit[end - n : end] = True
        items.update(ids)
    runs = _runs(hit)
    original = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text.decode()))]
    return len(words), int(hit.sum()), runs, items, [(original[a][0], original[b][1]) for a, b in runs]


def _block(docs: DataFrame, patterns: list, keep: list[str], mark: str) -> DataFrame:
    """The columns `keep` of docs and the struct `mark`, which takes up what an earlier block put there."""
    shared, key = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(mark, T._parse_datatype_string(_MARK_SCHEMA))])
    text_at, carried = docs.columns.index("text"), docs.columns.index(mark) if mark in docs.columns else None
    kept = [docs.columns.index(c) for c in keep]

    def scan(batches):
        for batch in arrow_batches(batches):
            automaton = _automaton(key, shared.value)
            before = batch.column(carried).to_pylist() if carried is not None else [None] * batch.num_rows
            marks = []
            for text, earlier in zip(utf8(batch.column(text_at)), before, strict=True):
                spans = [(x["first"], x["last"]) for x in earlier["word_spans"]] if earlier else []
                n, n_hit, runs, items, chars = _scan(automaton, text, spans, set(earlier["items"]) if earlier else set())
                marks.append({
                    "n_words": n, "n_hit": n_hit, "items": sorted(items),
                    "word_spans": [{"first": a, "last": b} for a, b in runs],
                    "char_spans": [{"start": a, "end": b} for a, b in chars],
                })
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(marks, _MARK_ARROW)], [*keep, mark])

    return docs.mapInArrow(scan, schema)


def _marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], ngram: int, block_bytes: int) -> tuple[DataFrame, str]:
    """The columns `keep` of docs and what a scan found, in one struct column of a name that docs doesn't have."""
    mark = "contamination"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark += "_"
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Each word of an item starts a window of ngram words; with words of two bytes that is the most an item can grow.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size * ngram // 2 // block_bytes))
    for block in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        by_window: dict[bytes, set[str]] = {}
        for item_id, text in part.collect():
            for window in windows(text.encode(), ngram):
                by_window.setdefault(window, set()).add(item_id)
        patterns = [(w, w.count(b" ") + 1, sorted(ids)) for w, ids in by_window.items()]
        docs = _block(docs, patterns, keep if block == n_blocks - 1 else list(dict.fromkeys([*keep, "text"])), mark)
    return docs, mark


def _contaminated(mark: str):
    n_hit, n_words = F.col(mark)["n_hit"], F.col(mark)["n_words"]
    return (n_hit > 0) & (20 * n_hit >= n_words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, word_spans and char_spans (runs of hit words), contaminated."""
    marked, mark = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, ["doc_id"], ngram, block_bytes)
    return marked.select("doc_id", f"{mark}.*", _contaminated(mark).alias("contaminated"))


def contamination_digest(found: DataFrame) -> DataFrame:
    """The columns of query op1, from what find_contamination returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns; row by row, without a join."""
    marked, mark = _marked(docs, benchmark, docs.columns, ngram, block_bytes)
    return marked.where(~_contaminated(mark)).drop(mark)


def brute_force(docs: list[tuple], items: list[tuple], ngram: int = NGRAM) -> list[tuple]:
    """The digest rows by plain search, for tests."""
    def words_of(text):
        return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    rows = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            n = min(ngram, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return rows
