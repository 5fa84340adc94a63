"""Collocations from count tries.

Each shard (about `TRIE_BYTES` of text of a language) is counted into a trie of its phrases of up to `DEPTH` words: level k has
the phrases of k words in order, each as its parent's place on the level above, a word, and a count. A trie is written in
sorted pieces. Then the tries are merged by prefix ranges: a range goes from one (language, first word, second word) to the next,
so a first word of any frequency is dealt over many ranges, and the k sorted tries' parts in a range are merged by one task. The
trie of a range that starts inside a first word also gets that word's node, so that every phrase has its whole path at hand:
walking up from a phrase gives the counts of its left parts, and its children say how often it is part of a longer phrase. More
than `FAN_IN` shards are first merged in sets of so many, by fewer ranges, and their tries cut again.

What is frequent enough is a table of nodes. The suffix link of a phrase is the phrase without its first word; levels are
joined along these links from the shortest on, each giving the counts of its right parts to those that link to it. A phrase that
a thousandth of a level's occurrences are (at most a thousand) is joined by a broadcast, the others by their text.

Range bounds are taken from the pieces' first keys (a sample of `MOST_KEYS` where there are more), as a range sort of Spark does;
they balance tasks and change no result.

Defined results: null and empty texts have no words; a null language is `und`, as is the language of that name; ties are ordered
by the phrase's bytes; repeated rows count each; texts of any length are counted whole, beyond TRIE_BYTES in slices that lend
the next one their last words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialise

DEPTH = 3
MIN_COUNT = 10
MOST_PHRASES = 2000
#: A phrase goes that a longer one has in at least so many of a hundred occurrences.
COVERED_PERCENT = 50
TRIE_BYTES = 8 << 20
#: Nodes of a piece, and of the pieces that a range has before they are merged, about.
PIECE_NODES, RANGE_NODES = 1 << 16, 1 << 19
#: Tries that meet in a task at most; ranges of a round that merges sets of them.
FAN_IN, SET_RANGES = 512, 1024
MOST_KEYS = 100_000
HEAVY_SHARE = 1000
#: Tasks that a language's best phrases are first chosen in.
SALTS = 64

#: A byte that no UTF-8 text has stands for the end of a piece of text.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")
_PIECE = "lang string, shard long, first binary, second binary, last binary, n long, n_words long, words binary, levels binary"
_Key = tuple[bytes, bytes, bytes]
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def _ids(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in the order of their bytes, and each word's place among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order with their counts' sums, and each key's place among them. The sort merges runs in order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts, place


class Trie:
    """words in order; levels of (parent, word, count) arrays, each in the order of its phrases. Parents of level 1 are 0."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.words, self.levels = words, levels

    @classmethod
    def count(cls, words: pa.Array, lead: int = 0, depth: int = DEPTH) -> Trie:
        """The trie of a sequence of words and breaks; phrases that end before place `lead` are counted elsewhere."""
        vocabulary, ids = _ids(words)
        n = len(vocabulary)
        real = ids != n - 1 if n and vocabulary[n - 1].as_py() == _BREAK else np.ones(len(ids), dtype=bool)
        levels, starts, parents = [], np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for k in range(depth):
            ends = starts + k
            fits = ends < len(ids)
            fits[fits] = real[ends[fits]]
            starts, parents = starts[fits], parents[fits]
            keys, counts, place = _summed(parents * n + ids[starts + k], (starts + k >= lead).astype(np.int64))
            levels.append((keys // max(n, 1), keys % max(n, 1), counts))
            parents = place
        return cls(vocabulary, levels)

    @classmethod
    def merge(cls, tries: list[Trie]) -> Trie:
        """The trie of all counts."""
        vocabulary, ids = _ids(pa.concat_arrays([t.words for t in tries]))
        n = len(vocabulary)
        at = np.cumsum([0] + [len(t.words) for t in tries])
        place = [np.zeros(1, dtype=np.int64)] * len(tries)
        levels = []
        for k in range(len(tries[0].levels)):
            parts = [t.levels[k] for t in tries]
            keys = [p[parent] * n + ids[a:][word] for p, (parent, word, _), a in zip(place, parts, at, strict=False)]
            keys, counts, places = _summed(np.concatenate(keys), np.concatenate([c for _, _, c in parts]))
            levels.append((keys // max(n, 1), keys % max(n, 1), counts))
            place = np.split(places, np.cumsum([len(c) for _, _, c in parts])[:-1])
        return cls(vocabulary, levels)

    def _start(self, key: tuple[bytes, bytes] | None, first: int, second: int) -> tuple[int, int]:
        """Places on levels 1 and 2 from which phrases are at or after a key of two words; defaults where there is no key."""
        if key is None:
            return first, second
        word = [bisect.bisect_left(_Words(self.words), w) for w in key]
        top, (parent, second_word, _) = self.levels[0][1], self.levels[1]
        at = int(np.searchsorted(top, word[0]))
        if at == len(top) or self.words[int(top[at])].as_py() != key[0]:
            return at, int(np.searchsorted(parent, at))
        a, b = np.searchsorted(parent, (at, at + 1))
        return at, int(a + np.searchsorted(second_word[a:b], word[1]))

    def between(self, low: tuple[bytes, bytes] | None, high: tuple[bytes, bytes] | None) -> Trie:
        """The phrases from one key of two words up to another, and the node of low's first word."""
        i, j = self._start(low, 0, 0), self._start(high, len(self.levels[0][1]), len(self.levels[1][1]))
        if high is not None and high[1] and j[0] < len(self.levels[0][1]) and self.words[int(self.levels[0][1][j[0]])].as_py() == high[0]:
            j = (j[0] + 1, j[1])  # the word itself comes before its pairs
        spans = [(i[0], max(i[0], j[0])), (i[1], max(i[1], j[1]))]
        for parent, _, _ in self.levels[2:]:
            spans.append(tuple(int(x) for x in np.searchsorted(parent, spans[-1])))
        levels, above = [], 0
        for (a, b), (parent, word, count) in zip(spans, self.levels, strict=True):
            levels.append((parent[a:b] - above, word[a:b], count[a:b]))
            above = a
        used, place = np.unique(np.concatenate([w for _, w, _ in levels]), return_inverse=True)
        cuts = np.cumsum([len(w) for _, w, _ in levels])[:-1]
        return Trie(self.words.take(pa.array(used)), [(p, w, c) for (p, _, c), w in zip(levels, np.split(place, cuts), strict=True)])

    def without(self, word: bytes) -> Trie:
        """The same with no occurrences of the one word `word`, which another piece counts."""
        parent, ids, count = self.levels[0]
        if len(ids) and self.words[int(ids[0])].as_py() == word:
            count = np.concatenate(([0], count[1:]))
        return Trie(self.words, [(parent, ids, count), *self.levels[1:]])

    def pieces(self, low: tuple[bytes, bytes] | None = None):
        """(first key, trie) of consecutive parts of about PIECE_NODES; each word is counted in its first part."""
        parent, word, _ = self.levels[1]
        weights = [np.ones(len(w), dtype=np.int64) for _, w, _ in self.levels]
        for k in range(len(self.levels) - 1, 1, -1):
            np.add.at(weights[k - 1], self.levels[k][0], weights[k])
        step = np.cumsum(weights[1]) // PIECE_NODES
        cuts = np.flatnonzero(step[1:] != step[:-1]) + 1
        top = self.levels[0][1]
        keys = [low, *[(self.words[int(top[parent[c]])].as_py(), self.words[int(word[c])].as_py()) for c in cuts], None]
        for a, b in zip(keys[:-1], keys[1:], strict=True):
            part = self.between(a, b)
            yield a or (b"", b""), part.without(a[0]) if a and a[1] else part

    def packed(self) -> tuple[bytes, bytes]:
        """The words, and the levels: parents as differences, all numbers in as few bytes as an array needs."""
        out = [len(self.levels).to_bytes(1, "little")]
        for parent, word, count in self.levels:
            for values in (np.diff(parent, prepend=0), word, count):
                kind = next(k for k, t in enumerate(_WIDTHS) if not len(values) or values.max() <= np.iinfo(t).max)
                out += [bytes([kind]), len(values).to_bytes(8, "little"), values.astype(_WIDTHS[kind]).tobytes()]
        pack = zstandard.ZstdCompressor(level=1).compress
        return pack(b" ".join(self.words.to_pylist())), pack(b"".join(out))

    @classmethod
    def unpacked(cls, words: bytes, levels: bytes) -> Trie:
        unpack = zstandard.ZstdDecompressor().decompress
        data, words, at, out = unpack(levels), unpack(words), 1, []
        for _ in range(data[0]):
            columns = []
            for _ in range(3):
                width, n = _WIDTHS[data[at]], int.from_bytes(data[at + 1 : at + 9], "little")
                columns.append(np.frombuffer(data, width, n, at + 9).astype(np.int64))
                at += 9 + n * np.dtype(width).itemsize
            out.append((np.cumsum(columns[0]), *columns[1:]))
        return cls(_words(words), out)


class _Words:
    """An Arrow array of words as a sequence to bisect."""

    def __init__(self, words: pa.Array) -> None:
        self.words = words

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, i: int) -> bytes:
        return self.words[i].as_py()


def _count(batches):
    """Pieces of the tries of a partition's texts: (lang, text) in, a row for each piece out."""
    texts: dict[str, list[bytes]] = {}
    size, shard = 0, TaskContext.get().partitionId() << 32

    def rows(lang: str, words: pa.Array, lead: int = 0):
        nonlocal shard
        shard += 1
        n_words = len(words) - lead - pc.sum(pc.equal(words[lead:], pa.scalar(_BREAK, words.type))).as_py() if len(words) > lead else 0
        yield from _piece_rows(lang, shard, Trie.count(words, lead).pieces(), n_words)

    def flush():
        nonlocal size
        while texts:
            lang, held = texts.popitem()
            yield from rows(lang, _words(_BREAK.join(held)))
        size = 0

    for batch in arrow_batches(batches):
        column = batch.column(1).cast(pa.large_binary())
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = (column[i].as_py() or b"").translate(_TABLE)
            if len(text) > TRIE_BYTES:
                last = _words(b"")
                for part in _slices(text):
                    words = pa.concat_arrays([last, _words(part)])
                    yield from rows(lang, words, len(last))
                    last = words[max(0, len(words) - (DEPTH - 1)) :]
                continue
            texts.setdefault(lang, []).append(text)
            size += len(text)
            if size >= TRIE_BYTES:
                yield from flush()
    yield from flush()


def _words(text: bytes) -> pa.Array:
    """The words and breaks of a text, split by Arrow, which needs no object for each."""
    text = text.replace(_BREAK, b" " + _BREAK + b" ").strip()
    if not text:
        return pa.array([], pa.large_binary())
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], dtype=np.int64)), pa.py_buffer(text)])
    return pc.ascii_split_whitespace(whole).values.cast(pa.large_binary())


def _slices(text: bytes):
    """Parts of a text of about TRIE_BYTES that end at a blank or a break; a longer word stays whole."""
    start = 0
    while start < len(text):
        end = start + TRIE_BYTES
        if end < len(text):
            at = max(text.rfind(b" ", start, end), text.rfind(_BREAK, start, end))
            if at < 0:
                at = min((x for x in (text.find(b" ", end), text.find(_BREAK, end)) if x >= 0), default=len(text) - 1)
            end = at + 1
        yield text[start:end]
        start = end


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


_B, _L = pa.binary(), pa.int64()
_PIECE_TYPES = [("lang", pa.string()), ("shard", _L), ("first", _B), ("second", _B), ("last", _B), ("n", _L), ("n_words", _L), ("words", _B), ("levels", _B)]
_PART = "of long, range int, lang string, low_first binary, low_second binary, words binary, levels binary"
_PART_TYPES = [("of", _L), ("range", pa.int32()), ("lang", pa.string()), ("low_first", _B), ("low_second", _B), ("words", _B), ("levels", _B)]
_NODE = "lang string, phrase string, size int, a long, rest string, lefts array<long>, cover long"


def _piece_rows(lang: str, shard: int, pieces, n_words: int):
    for (first, second), trie in pieces:
        top = trie.levels[0][1]
        if len(top) or n_words:
            last = trie.words[int(top[-1])].as_py() if len(top) else b""
            yield _batch([(lang, shard, first, second, last, sum(len(w) for _, w, _ in trie.levels), n_words, *trie.packed())], _PIECE_TYPES)
        n_words = 0  # counted in the first piece


def _bounds(pieces: DataFrame, n_ranges: int, n_pieces: int) -> list[_Key]:
    """The keys that part the pieces' nodes into ranges of like numbers of pieces."""
    keys = pieces.select("lang", "first", "second")
    if n_pieces > MOST_KEYS:
        keys = keys.sample(MOST_KEYS / n_pieces, seed=1)
    keys = sorted((r["lang"].encode(), bytes(r["first"]), bytes(r["second"])) for r in keys.collect())
    return sorted({keys[len(keys) * k // n_ranges] for k in range(1, n_ranges)}) if keys else []


def _merged(pieces: DataFrame, bounds: list[_Key], sets: int | None) -> DataFrame:
    """The pieces' tries merged by ranges: pieces again, one trie for each of so many sets of shards; or, of all shards, the
    nodes that are frequent enough."""
    def cut(batches):
        for batch in arrow_batches(batches):
            for i in range(batch.num_rows):
                lang, shard, first, second, last, _, _, words, levels = (c[i].as_py() for c in batch.columns)
                trie, name = Trie.unpacked(words, levels), lang.encode()
                start = r = bisect.bisect_right(bounds, (name, first, second))
                # Ranges up to that of the last word, and those that start inside that word.
                while r == start or (r <= len(bounds) and bounds[r - 1][:2] <= (name, last)):
                    low = bounds[r - 1][1:] if r and bounds[r - 1][0] == name else None
                    high = bounds[r][1:] if r < len(bounds) and bounds[r][0] == name else None
                    part = trie.between(low, high)
                    if len(part.levels[1][1]) or part.levels[0][2].any():
                        yield _batch([(shard % (sets or 1), r, lang, *(low or (None, None)), *part.packed())], _PART_TYPES)
                    r += 1

    def merge(batches):
        def done():
            (of, _, lang, low), trie = at, Trie.merge(tries)
            if sets:
                yield from _piece_rows(lang, of, trie.pieces(low), 0)
            else:
                yield from _frequent(lang, trie, low)

        at, tries = None, []
        for batch in arrow_batches(batches):
            for of, r, lang, first, second, words, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (of, r, lang, None if first is None else (first, second))
                if at is not None and key != at:
                    yield from done()
                    tries = []
                at = key
                tries.append(Trie.unpacked(words, levels))
        if tries:
            yield from done()

    n_tasks = (len(bounds) + 1) * (sets or 1)
    parts = pieces.mapInArrow(cut, _PART).repartition(n_tasks, "of", "range").sortWithinPartitions("of", "range", "lang")
    return parts.mapInArrow(merge, _PIECE if sets else _NODE)


def _frequent(lang: str, trie: Trie, low: tuple[bytes, bytes] | None):
    """The nodes of a range's trie that occur often enough: what their walk to the top and their children say."""
    paths: list[list[np.ndarray]] = []  # of each level's nodes: their places on all levels so far
    for k, (parent, word, count) in enumerate(trie.levels):
        paths.append([p[parent] for p in (paths[-1] if k else [])] + [np.arange(len(word))])
        cover = np.zeros(len(word), dtype=np.int64)
        if k + 1 < len(trie.levels):
            below, _, counts = trie.levels[k + 1]
            frequent = counts >= MIN_COUNT
            np.maximum.at(cover, below[frequent], counts[frequent])
        found = count >= MIN_COUNT
        if k == 0 and low and low[1] and len(word) and trie.words[int(word[0])].as_py() == low[0]:
            found[0] = False  # another range's
        at = np.flatnonzero(found)
        if not len(at):
            continue
        path = [p[at] for p in paths[k]]
        words = [trie.words.take(pa.array(trie.levels[j][1][p])) for j, p in enumerate(path)]
        text = lambda ws: pc.binary_join_element_wise(*ws, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).cast(pa.string())  # noqa: E731
        lefts = np.stack([trie.levels[j][2][p] for j, p in enumerate(path[:-1])], axis=1).ravel() if k else np.zeros(0, dtype=np.int64)
        columns = [
            pa.array([lang] * len(at), pa.string()), text(words), pa.array([k + 1] * len(at), pa.int32()), pa.array(count[at]),
            text(words[1:]) if k else pa.nulls(len(at), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(lefts)), pa.array(cover[at]),
        ]
        batch = pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "a", "rest", "lefts", "cover"])
        for start in range(0, batch.num_rows, 10_000):
            yield batch.slice(start, 10_000)


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The nodes that occur MIN_COUNT times or more (lang, phrase, size, a, rest, lefts, cover), the words of each language
    (lang, n), and of all."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    pieces = materialise(texts.mapInArrow(_count, _PIECE), "tries")
    words = materialise(pieces.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
    n_shards = pieces.select("shard").distinct().count()
    while True:
        n_pieces, n_nodes = pieces.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_ranges = -(-n_nodes // RANGE_NODES)
        if n_shards <= FAN_IN:
            nodes = materialise(_merged(pieces, _bounds(pieces, max(1, n_ranges), n_pieces), None), "phrases")
            return nodes, words, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        n_shards = -(-n_shards // FAN_IN)
        pieces = materialise(_merged(pieces, _bounds(pieces, max(1, min(n_ranges, SET_RANGES)), n_pieces), n_shards), "tries")


def _along_links(rows: DataFrame, linked: DataFrame, total: int) -> DataFrame:
    """rows with the counts of their right parts, from the nodes that they link to (a, rights)."""
    linked = linked.select(F.col("lang"), F.col("phrase").alias("rest"), F.concat(F.array("a"), "rights").alias("rights"), (F.col("a") * HEAVY_SHARE > total).alias("heavy"))
    heavy = linked.where("heavy").drop("heavy")
    rows = rows.join(F.broadcast(heavy), ["lang", "rest"], "left")
    # A node that n rows link to occurs MIN_COUNT * n times or more.
    return rows.where("rights is not null").unionByName(rows.where("rights is null").drop("rights").join(linked.where("not heavy").drop("heavy"), ["lang", "rest"]))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best MOST_PHRASES phrases of two words or more."""
    nodes, words, total = frequent_phrases(docs)
    levels = [nodes.where("size = 1").withColumn("rights", F.array().cast("array<long>"))]
    for size in range(2, DEPTH + 1):
        levels.append(materialise(_along_links(nodes.where(F.col("size") == size), levels[-1], total), "linked"))
    kept = []
    for size in range(2, DEPTH + 1):
        rows = levels[size - 1]
        if size < DEPTH:  # the longer ones that end with the phrase link to it; those that start with it are its children
            longer = levels[size].groupBy("lang", F.col("rest").alias("phrase")).agg(F.max("a").alias("ends"))
            rows = rows.join(longer, ["lang", "phrase"], "left")
            rows = rows.where(100 * F.greatest("cover", F.coalesce("ends", F.lit(0))) < COVERED_PERCENT * F.col("a")).drop("ends")
        kept.append(rows)
    # Exact: a decimal of 38 digits holds 1,000,000 * a * a up to a = 10^16.
    scores = F.expr("zip_with(lefts, rights, (l, r) -> (1000000 * cast(a as decimal(19, 0)) * a) div (cast(l as decimal(19, 0)) * r))")
    scored = reduce(DataFrame.unionByName, kept).withColumn("scores", scores)
    cut = F.array_position("scores", F.array_min("scores")).cast("int")
    scored = scored.select("lang", "phrase", "a", F.element_at("lefts", cut).alias("l"), F.element_at("rights", cut).alias("r"), F.array_min("scores").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most phrases: its best of each of many parts, then the best of those.
    of_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    scored = scored.withColumn("rank", F.row_number().over(of_part)).where(F.col("rank") <= MOST_PHRASES)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= MOST_PHRASES)
    return scored.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?

]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT lang, unnest(list_zip(ws, ws[2:], ws[3:])) AS t FROM lists)),
counted AS MATERIALIZED (
  SELECT lang, 1 AS size, a AS phrase, NULL AS head, NULL AS rest, NULL AS head2, NULL AS rest2, count(*) AS f FROM words GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, a, b, NULL, NULL, count(*) FROM words WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, a, b || ' ' || c, a || ' ' || b, c, count(*) FROM words WHERE c IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, 1 AS k, head, rest FROM candidates UNION ALL SELECT lang, phrase, f, 2, head2, rest2 FROM candidates WHERE size = 3),
halves AS MATERIALIZED (SELECT c.*, l.f AS l FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.head),
scored AS (
  SELECT c.lang, c.phrase, a, k, l, r.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r.f) AS score
  FROM halves c JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part AS phrase, max(f) AS f FROM (SELECT lang, f, unnest([head2, rest]) AS part FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
