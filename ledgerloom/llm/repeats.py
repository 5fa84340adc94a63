"""Removal of strings that an earlier document has, by prefix doubling over sampled suffixes.

A byte goes if a string of `THRESHOLD` bytes that covers it also starts in a document of a smaller id.
Prefix doubling ranks suffixes by their first k bytes, drops those whose rank is unique, and ranks the rest
by pairs of ranks at a growing offset until the threshold is reached. Here a rank is a fingerprint of the
prefix, so it needs no global numbering: the rank of 2k bytes is made from the pair of k-byte ranks, at
positions i and i + k, where the text is, and only ranks travel. Ranks of 1, 2, 4, 8, 16 and 25 bytes are
made so in numpy from the bytes on, each from a pair through a mixing step that is not linear. From 25 bytes
on, Spark deals the ranks by value, a partition's ranks are sorted, and what comes back says whether a rank
occurs in a smaller or a larger document. Three rounds:

1. k = 25. Of the positions in each window of 50 bytes only the one with the smallest rank is ranked (a
   suffix array needs no more of them to see each 50-byte repeat). Windows whose position is unique to
   their document are done; that is most of the corpus.
2. Longer prefixes: text between positions chosen by content, with the windows that start there, ranked by a
   hash of 96 bits. Where such a stretch is in a smaller document, all its windows are, and no smaller
   document is needed from it.
3. k = 50, pairs of 25-byte ranks at offset 25, for all windows that are still open. 88 bits of the pair's
   rank are compared, and the partition's: at 10^12 open windows about two in a thousand such corpora would
   have one false match.

Ranking every position instead would shuffle some 16 bytes for each byte of text in each round.

Documents are first packed into batches of about `BATCH_BYTES`, written once to a table bucketed by batch;
each round reads it again, so that text is never shuffled and rounds agree on the batches. A document beyond
`PIECE_BYTES` is cut into pieces that overlap by a window less a byte, and put together at the end. All that
is shuffled are ranks, in blobs by batch and part of the ranks, and bits that come back. A rank that a third
of all documents have costs one entry per batch. The number of parts follows from the bytes of text, and a
task compares one part at a time.

Defined results: null or empty text has no bytes; documents under 50 bytes lose nothing; documents of
equal id don't count as smaller to each other; a null id counts as larger than all others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, at_end, materialise, scratch, utf8

THRESHOLD = 50
HALF = 25
BATCH_BYTES = 2 << 20
#: Longer documents are cut.
PIECE_BYTES = 8 << 20
#: Bytes of text whose ranks make a part, and the most tasks that parts are dealt to.
PART_BYTES, MOST_TASKS = 64 << 20, 20_000
#: One of so many positions, by content, ends a stretch of round 2.
STRETCH = 64
_NO_ID = (1 << 63) - 1
#: Bytes of a rank, and of the second rank that is compared beside it, that are sent in each round; the first round only
#: says which windows may repeat.
_SENT = {1: (5, 0), 2: (8, 4), 3: (7, 4)}

_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of two prefixes in a row, from their ranks."""
    h = a * _M
    h += b
    h ^= h >> np.uint64(32)
    h *= _N
    h ^= h >> np.uint64(29)
    return h


def _ranks(data: np.ndarray) -> np.ndarray:
    """The ranks of the HALF bytes from each position on, by doubling."""
    rank, k = _BYTES[data], 1
    while k < HALF and len(rank):
        offset = min(k, HALF - k)
        rank, k = _paired(rank[:-offset], rank[offset:]), k + offset
    return rank[: max(0, len(data) - HALF + 1)]


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, length = values, 1
    while 2 * length <= width:
        out, length = np.minimum(out[:-length], out[length:]), 2 * length
    if length < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - length : width - length + n])
    return out


class _Entries:
    """Distinct ranks of a batch with the first and last of its documents that have each, in the order they are sent."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, n_parts: int, seconds: np.ndarray | None = None, deal_by_low_bits: bool = False) -> None:
        self.docs = docs
        order = np.lexsort((docs, keys) if seconds is None else (docs, seconds, keys))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        if seconds is not None:
            seconds = seconds[order]
            new[1:] |= seconds[1:] != seconds[:-1]
        #: The entry of each rank as they came.
        self.entry = np.empty(len(keys), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.keys, self.first = keys[at], docs[at]
        self.seconds = seconds[at] if seconds is not None else None
        self.last = docs[np.concatenate((at[1:], [len(keys)])) - 1] if len(at) else docs[:0]
        # The smallest ranks of windows are small numbers; their low bits are as good as random.
        bits = self.keys & np.uint64(0xFFFFFFFF) if deal_by_low_bits else self.keys >> np.uint64(32)
        self.part = (bits * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
        # By part, then by document: documents compress well then.
        self.sent = np.lexsort((self.first, self.part))
        self.smaller = self.larger = None

    def blobs(self, batch: int, ids: np.ndarray, width: tuple[int, int]):
        """(part, batch, keys, documents, n) of each part that has entries."""
        pack = zstandard.ZstdCompressor(level=1)
        part = self.part[self.sent]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else [0]
        head = pack.compress(np.diff(ids, prepend=0).tobytes())
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = self.sent[a:b]
            keys = np.empty((b - a, sum(width)), dtype=np.uint8)
            keys[:, : width[0]] = self.keys[at].view(np.uint8).reshape(-1, 8)[:, : width[0]]
            if width[1]:
                keys[:, width[0] :] = self.seconds[at].view(np.uint8).reshape(-1, 4)[:, : width[1]]
            first, last, of = self.first[at], self.last[at], head
            if b - a < len(ids) // 4:  # few entries: only the ids that they need
                used, place = np.unique(np.concatenate((first, last)), return_inverse=True)
                first, last, of = place[: b - a], place[b - a :], pack.compress(np.diff(ids[used], prepend=0).tobytes())
            spans = np.stack((np.diff(first, prepend=0), last - first)).astype(np.int32)
            yield int(part[a]), batch, keys.tobytes(), of, pack.compress(spans.tobytes()), int(b - a)

    def take(self, flags: list | None) -> None:
        """What came back: for each part, whether each entry is in a smaller or a larger document of another batch."""
        self.smaller, self.larger = (np.zeros(len(self.keys), dtype=bool) for _ in range(2))
        if flags:
            bits = np.concatenate([np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=2 * f["n"]) for f in sorted(flags, key=lambda f: f["part"])])
            self.smaller[self.sent], self.larger[self.sent] = bits[0::2].astype(bool), bits[1::2].astype(bool)

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """For each rank as they came: is it in a smaller document, and in a larger one?"""
        if not len(self.keys):
            return np.zeros(len(self.docs), dtype=bool), np.zeros(len(self.docs), dtype=bool)
        at, docs = self.entry, self.docs
        return self.smaller[at] | (self.first[at] < docs), self.larger[at] | (self.last[at] > docs)


class _Batch:
    """The windows of a batch of documents, and what is known of each after each round."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, text: bytes, n_parts: int) -> None:
        self.n_parts, self.lengths, self.text = n_parts, lengths, text
        data = np.frombuffer(text, dtype=np.uint8)
        self.n = max(0, len(data) - THRESHOLD + 1)
        # Sorted distinct ids; documents are compared by their place among them.
        self.ids, rank = np.unique(ids, return_inverse=True)
        doc = np.repeat(rank.astype(np.int32), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.doc = doc[: self.n]
        self.valid = np.arange(self.n) + THRESHOLD <= ends[: self.n]
        self.half = _ranks(data)

    def round_1(self) -> _Entries:
        smallest = _window_minimum(self.half, THRESHOLD - HALF + 1) if self.n else np.empty(0, np.uint64)
        value, doc = smallest[self.valid], self.doc[self.valid]
        # Neighbouring windows mostly share their smallest position.
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(value) else np.empty(0, bool)
        self.run = np.cumsum(new) - 1
        self.entries = _Entries(value[new], doc[new], self.n_parts, deal_by_low_bits=True)
        return self.entries

    def after_1(self, flags) -> None:
        self.entries.take(flags)
        smaller, larger = self.entries.known()
        self.open = np.zeros(self.n, dtype=bool)
        self.open[self.valid] = (smaller | larger)[self.run]

    def round_2(self) -> _Entries:
        """Stretches from one chosen position to the next whose windows are all open."""
        cuts = np.flatnonzero((self.half[: self.n] & np.uint64(STRETCH - 1)) == 0)
        closed = np.concatenate(([0], np.cumsum(~self.open)))
        a, b = cuts[:-1], cuts[1:]
        good = closed[b] == closed[a]
        self.stretch = a[good], b[good]
        digest = b"".join([xxhash.xxh3_128_digest(self.text[x : y + THRESHOLD - 1]) for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True)])
        both = np.frombuffer(digest, dtype=np.uint64).reshape(-1, 2)
        self.entries = _Entries(both[:, 0].copy(), self.doc[self.stretch[0]], self.n_parts, (both[:, 1] >> np.uint64(32)).astype(np.uint32))
        return self.entries

    def after_2(self, flags) -> None:
        self.entries.take(flags)
        smaller, _ = self.entries.known()
        change = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(change, self.stretch[0][smaller], 1)
        np.add.at(change, self.stretch[1][smaller], -1)
        self.repeated = np.cumsum(change)[: self.n] > 0
        self.open &= ~self.repeated

    def round_3(self) -> _Entries:
        self.at = np.flatnonzero(self.open)
        a, b = self.half[self.at], self.half[self.at + HALF]
        self.entries = _Entries(_paired(a, b), self.doc[self.at], self.n_parts, (_paired(b, a ^ _N) >> np.uint64(32)).astype(np.uint32))
        return self.entries

    def after_3(self, flags) -> None:
        self.entries.take(flags)
        smaller, _ = self.entries.known()
        self.repeated[self.at[smaller]] = True

    def removed(self) -> np.ndarray:
        """Which bytes of the batch a repeated window covers."""
        start = np.flatnonzero(self.repeated)
        change = np.zeros(int(self.lengths.sum()) + 1, dtype=np.int32)
        change[start] += 1
        change[start + THRESHOLD] -= 1
        return np.cumsum(change)[:-1] > 0


_TABLE = "batch long, ids binary, lengths binary, text binary, whole long, piece int"


def _pack(frame: DataFrame, n_buckets: int) -> str:
    """Write frame's documents in batches to a bucketed table; returns its name. whole and piece are null, but for a batch
    that is a piece of a longer document."""
    def pack(batches):
        ids, texts, size, n_batches = [], [], 0, 0
        own = uuid.uuid4()
        names = ["batch", "ids", "lengths", "text", "whole", "piece"]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32())

        def row(whole=None, piece=None):
            nonlocal n_batches
            values = ((own.int + n_batches) % (1 << 62), np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts), whole, piece)
            n_batches += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in arrow_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if ids and (size + len(text) > BATCH_BYTES or len(text) > PIECE_BYTES):
                    yield row()
                    ids, texts, size = [], [], 0
                doc_id = _NO_ID if doc_id is None else doc_id
                if len(text) > PIECE_BYTES:
                    whole = (own.int + n_batches) % (1 << 62)
                    for piece, at in enumerate(range(0, len(text) - THRESHOLD + 1, PIECE_BYTES)):
                        ids, texts = [doc_id], [text[at : at + PIECE_BYTES + THRESHOLD - 1]]
                        yield row(whole, piece)
                    ids, texts = [], []
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
        if ids:
            yield row()

    spark, name = frame.sparkSession, f"ledgerloom_batches_{uuid.uuid4().hex}"
    packed = frame.mapInArrow(pack, _TABLE)
    packed.write.bucketBy(n_buckets, "batch").option("path", scratch(spark, "repeat-batches")).option("compression", "zstd").saveAsTable(name)
    at_end(spark, lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return name


def _batch_of(batch: pa.RecordBatch, i: int, n_parts: int, rounds: int) -> tuple[int, np.ndarray, bytes, _Batch]:
    """Row i of a batch table with flags of so many rounds: its state after them."""
    number, ids, lengths, text = (batch.column(k)[i].as_py() for k in range(4))
    ids = np.frombuffer(ids, np.int64)
    b = _Batch(ids, np.frombuffer(lengths, np.int64), text, n_parts)
    for k in range(1, rounds + 1):
        getattr(b, f"round_{k}")()
        getattr(b, f"after_{k}")(batch.column(5 + k)[i].as_py())
    return number, ids, text, b


def _round(table: DataFrame, rounds: int, n_parts: int) -> DataFrame:
    """The next round over a batch table with the flags of those before: batch, and the flags by partition."""
    width = _SENT[rounds + 1]

    def send(batches):
        for batch in arrow_batches(batches):
            for i in range(batch.num_rows):
                number, _, _, b = _batch_of(batch, i, n_parts, rounds)
                rows = list(getattr(b, f"round_{rounds + 1}")().blobs(number, b.ids, width))
                del b
                if rows:
                    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "batch", "keys", "ids", "spans", "n"])

    def compare_part(part: int, rows) -> pa.RecordBatch:
        keys, seconds, first, last, source = [], [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for _, number, k, ids, spans, n in rows:
            sent = np.frombuffer(k, np.uint8).reshape(n, sum(width))
            full = np.zeros((n, 8), dtype=np.uint8)
            full[:, : width[0]] = sent[:, : width[0]]
            keys.append(full.view(np.uint64).reshape(-1))
            if width[1]:
                seconds.append(np.ascontiguousarray(sent[:, width[0] :]).view(np.uint32).reshape(-1))
            ids = np.cumsum(np.frombuffer(unpack.decompress(ids), np.int64))
            start, more = np.frombuffer(unpack.decompress(spans), np.int32).reshape(2, n)
            start = np.cumsum(start)
            first.append(ids[start])
            last.append(ids[start + more])
            source.append((number, n))
        keys, first, last = np.concatenate(keys), np.concatenate(first), np.concatenate(last)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        if width[1]:
            seconds = np.concatenate(seconds)
            differ = seconds[order][1:] != seconds[order][:-1]
            if (differ & ~new[1:]).any():  # equal ranks, different second ones
                order = np.lexsort((seconds, keys))
                new[1:] = (keys[order][1:] != keys[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        least, most = np.minimum.reduceat(first[order], begin)[group], np.maximum.reduceat(last[order], begin)[group]
        bits = np.empty((len(keys), 2), dtype=bool)
        bits[order, 0], bits[order, 1] = least < first[order], most > last[order]
        at, out = 0, []
        for number, n in source:
            out.append((number, part, n, np.packbits(bits[at : at + n].reshape(-1)).tobytes()))
            at += n
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["batch", "part", "n", "bits"])

    def compare(batches):
        rows = (row for batch in arrow_batches(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield compare_part(part, group)

    n_tasks = min(n_parts, MOST_TASKS)
    sent = table.mapInArrow(send, "part int, batch long, keys binary, ids binary, spans binary, n long")
    dealt = sent.withColumn("task", F.pmod("part", F.lit(n_tasks))).repartitionById(n_tasks, "task").drop("task").sortWithinPartitions("part")
    flags = dealt.mapInArrow(compare, "batch long, part int, n long, bits binary")
    return materialise(flags.groupBy("batch").agg(F.collect_list(F.struct("part", "n", "bits")).alias(f"flags_{rounds + 1}")), f"repeat-flags-{rounds + 1}")


_SPANS = "array<struct<start:long,end:long>>"


def _edges(removed: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], removed.view(np.int8), [0])))).tolist()
    return [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]


def _document(doc_id: int, text: bytes, removed: np.ndarray) -> tuple:
    kept = np.frombuffer(text, np.uint8)[~removed].tobytes() if removed.any() else text
    return None if doc_id == _NO_ID else doc_id, len(text), _edges(removed), hashlib.sha256(kept).hexdigest()


def _documents(rows) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (pa.int64(), pa.int64(), span, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start and end bytes to remove) and kept_sha256."""
    spark: SparkSession = docs.sparkSession
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = frame.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(n_buckets, -(-n_bytes // PART_BYTES))
    packed = spark.table(_pack(frame, n_buckets))
    table = packed
    for k in range(3):
        table = table.join(_round(table, k, n_parts), "batch", "left")

    def finish(batches):
        for batch in arrow_batches(batches):
            for i in range(batch.num_rows):
                _, ids, text, b = _batch_of(batch, i, n_parts, 3)
                removed, ends = b.removed(), np.cumsum(b.lengths).tolist()
                yield _documents([_document(d, text[e - n : e], removed[e - n : e]) for d, n, e in zip(ids.tolist(), b.lengths.tolist(), ends, strict=True)])

    schema = f"doc_id long, n_bytes long, spans {_SPANS}, kept_sha256 string"
    whole = table.where("whole is null").mapInArrow(finish, schema)
    if packed.where("whole is not null").isEmpty():
        return whole

    def pieces(batches):
        for batch in arrow_batches(batches):
            for i in range(batch.num_rows):
                _, ids, text, b = _batch_of(batch, i, n_parts, 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4).slice(i, 1), batch.column(5).slice(i, 1), pa.array([int(ids[0])]), pa.array([text], pa.binary()), pa.array([np.packbits(b.removed()).tobytes()], pa.binary())],
                    ["whole", "piece", "id", "text", "bits"],
                )

    def join(key, rows):
        rows = rows.sort_by("piece").to_pylist()
        text = b"".join(r["text"][: PIECE_BYTES if r is not rows[-1] else None] for r in rows)
        removed = np.zeros(len(text), dtype=bool)
        for r in rows:
            at = r["piece"] * PIECE_BYTES
            removed[at : at + len(r["text"])] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(r["text"])).astype(bool)
        return pa.Table.from_batches([_documents([_document(rows[0]["id"], text, removed)])])

    # One document is one group: it was one row before.
    cut = table.where("whole is not null").mapInArrow(pieces, "whole long, piece int, id long, text binary, bits binary")
    return whole.union(cut.groupBy("whole").applyInArrow(join, schema))


def repeat_digest(found: DataFrame) -> DataFrame:
    """The columns of query op7, from what repeated_spans returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_force(docs: list[tuple], threshold: int = THRESHOLD) -> list[tuple]:
    """The digest rows by a table of all strings, for tests."""
    first: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for doc_id, text in texts:
        for i in range(len(text) - threshold + 1):
            s = text[i : i + threshold]
            first[s] = min(first.get(s, doc_id), doc_id)
    rows = []
    for doc_id, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - threshold + 1):
            if first[text[i : i + threshold]] < doc_id:
                gone[i : i + threshold] = b"\1" * threshold
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        rows.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows
