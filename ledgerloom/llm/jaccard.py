"""N-gram Jaccard join with rare-first prefix filtering, and its connected groups.

A document's set holds its distinct shingles of five words. Documents with equal sets share a node, the
hash of the set, so copies are one node from the start. Two nodes link at a Jaccard similarity of 0.75.

1. A pass over the documents gives id, node and set size, and counts the shingles that repeat in a task.
   The most frequent ones, `FREQUENT` at most, order all shingles from rare to frequent; this order only
   decides how many candidates there are, not which pairs link.
2. Another pass emits each node's prefix: of n shingles the n - ceil(0.75 n) + 1 first in that order. Two
   sets that link share a shingle of both prefixes.
3. Prefix rows meet by shingle, sorted by set size. Neighbours at growing distances that pass the length
   and the positional filter and are not yet known to be connected become candidates. Distances go up to
   1, 32, 1024 ... until no group has rows farther apart that belong to different components. So a large
   group of near copies costs a few pairs per row rather than all pairs, and no pair is left untested that
   could connect two components.
4. Candidates are verified once per pair and round: a pass over the documents emits the sets of nodes in
   candidates (a bitmap tells most others apart, or a join where there are too many), they are joined to the pairs, and a
   suffix filter, bounding the overlap by counts in ranges of the hash, comes before the intersection.

Shingles are 64-bit hashes, and sets are compared by 40 bits of them.

Defined results: a document of one to four words has one shingle, the whole sequence; null, empty or blank
text has no set, links with nothing and is its own component; repeated documents fall together; a null id
counts as larger than all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, most_frequent, utf8, wrapped
from .components import components

NGRAM = 5
#: A link needs NUM / DEN of the union.
NUM, DEN = 3, 4
FREQUENT = 1 << 18
STEP = 32
#: log2 of the bits that tell nodes in candidates from others: at least, and at most (16 MB).
BITMAP_BITS, MOST_BITMAP_BITS = 24, 27
#: Tokens that are broadcast at most.
BROADCAST_TOKENS = 1 << 20
#: Parts that the rows of one token are dealt into beyond that.
SALTS = 16
HELD_SHINGLES = 4_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, known: _Words, ngram: int = NGRAM) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(ngram, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out * _M + h[k : len(words) - width + 1 + k])
    return np.unique(out)


def node_of(members: np.ndarray) -> int:
    """Hash of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64))


def least_overlap(sizes):
    """Smallest intersection with which sets of these sizes (added up) link: i >= NUM/DEN * (sizes - i)."""
    return -(-sizes * NUM // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def _frame(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _measured(frame: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """doc_id, text_hash, node, n by document; and the most frequent shingles with their counts."""
    def measure(batches):
        known, held, n_held = _Words(), [], 0

        def repeated():
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            empty = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(values), pa.array(counts)], ["doc_id", "text_hash", "node", "n", "shingle", "count"])

        for batch in arrow_batches(batches):
            nodes, sizes = [], []
            for text in utf8(batch.column(1)):
                members = shingles(text, known)
                nodes.append(node_of(members) if len(members) else None)
                sizes.append(len(members))
                held.append(members)
                n_held += len(members)
                if n_held > HELD_SHINGLES:
                    yield repeated()
                    held, n_held = [], 0
            empty = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), empty, empty], ["doc_id", "text_hash", "node", "n", "shingle", "count"])
        yield repeated()

    rows = materialise(frame.mapInArrow(measure, "doc_id long, text_hash long, node long, n long, shingle long, count long"), "jaccard-nodes")
    counts = rows.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count"))
    frequent = most_frequent(counts, "count", FREQUENT).collect()
    return rows.where("shingle is null").select("doc_id", "text_hash", "node", "n"), [(r["shingle"], r["count"]) for r in frequent]


def _prefixes(frame: DataFrame, frequent: list[tuple[int, int]]) -> DataFrame:
    """token, node, size, pos for the prefix of each node, once per node and task."""
    order = sorted(frequent)
    shared = frame.sparkSession.sparkContext.broadcast((
        np.array([s for s, _ in order], dtype=np.int64), np.array([c for _, c in order], dtype=np.int64)
    ))

    def emit(batches):
        values, counts = shared.value
        known, seen = _Words(), set()
        for batch in arrow_batches(batches):
            out, rows = [], 0
            for text in utf8(batch.column(1)):
                members = shingles(text, known)
                if not len(members) or (node := node_of(members)) in seen:
                    continue
                seen.add(node)
                signed = members.view(np.int64)
                frequency = np.zeros(len(signed), dtype=np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, signed), len(values) - 1)
                    frequency = np.where(values[at] == signed, counts[at], 0)
                p = prefix_length(len(signed))
                first = np.lexsort((signed, frequency))[:p]
                out.append((signed[first], np.full(p, node), np.full(p, len(signed), dtype=np.int32), np.arange(p, dtype=np.int32)))
                rows += p
                if rows > 200_000:
                    yield _columns(out)
                    out, rows = [], 0
            if out:
                yield _columns(out)

    return frame.mapInArrow(emit, "token long, node long, size int, pos int")


def _columns(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "node", "size", "pos"])


def _neighbours(rows: DataFrame, low: int, high: int) -> DataFrame:
    """From (token, node, size, pos, label), sorted by token and size: the candidate pairs low..high rows apart
    (a, b), and the rows of groups with rows farther apart (token, node, size, pos)."""
    names = ["a", "b", "token", "node", "size", "pos"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def pair(batches):
        # Carried over from earlier batches: the last high + 1 rows, whose groups may go on.
        carry = {k: np.empty(0, dtype=np.int64) for k in ("token", "node", "size", "pos", "label", "rank")}

        def go(rows: dict, fresh: int, last: bool):
            """rows: the carried ones, then fresh ones. Emits what can be decided, carries the rest."""
            n = len(rows["token"])
            token, size, pos, node, label = (rows[k] for k in ("token", "size", "pos", "node", "label"))
            found = []
            for d in range(low, min(high, n - 1) + 1):
                i = np.arange(max(0, n - fresh - d), n - d)
                j = i + d
                keep = (token[i] == token[j]) & (label[i] != label[j]) & (DEN * size[i] >= NUM * size[j])
                i, j = i[keep], j[keep]
                most = np.minimum(size[i] - pos[i], size[j] - pos[j])
                keep = most >= least_overlap(size[i] + size[j])
                if keep.any():
                    found.append((node[i[keep]], node[j[keep]]))
            decided = n if last else max(0, n - high - 1)
            i = np.arange(decided)
            j = i + np.maximum(high + 1 - rows["rank"][:decided], 0)
            wide = token[i] == token[np.minimum(j, max(n - 1, 0))]
            open_ = i[wide & (j < n)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                a, b = np.minimum(a, b), np.maximum(a, b)
                pairs = np.unique(np.stack((a, b), axis=1), axis=0)
            else:
                pairs = np.empty((0, 2), dtype=np.int64)
            empty, nothing = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(open_), pa.int64())
            columns = [
                pa.concat_arrays([pa.array(pairs[:, 0]), nothing]), pa.concat_arrays([pa.array(pairs[:, 1]), nothing]),
                *(pa.concat_arrays([empty.cast(t), pa.array(rows[k][open_]).cast(t)]) for k, t in zip(names[2:], types[2:], strict=True)),
            ]
            kept = {k: v[decided:] for k, v in rows.items()}
            return pa.RecordBatch.from_arrays(columns, names), kept

        for batch in arrow_batches(batches):
            new = {k: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(("token", "node", "size", "pos", "label"))}
            # A node comes once per task that has it; its rows of one token are alike and adjacent.
            token, node = new["token"], new["node"]
            before = (carry["token"][-1], carry["node"][-1]) if len(carry["token"]) else (None, None)
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            fresh[0] = (token[0], node[0]) != before
            new = {k: v[fresh] for k, v in new.items()}
            if not (m := len(new["token"])):
                continue
            starts = np.concatenate(([True], new["token"][1:] != new["token"][:-1]))
            first = np.maximum.accumulate(np.where(starts, np.arange(m), 0))
            rank = np.arange(m) - first
            if len(carry["token"]) and carry["token"][-1] == new["token"][0]:
                rank[first == 0] += carry["rank"][-1] + 1
            rows = {k: np.concatenate((carry[k], v)) for k, v in (new | {"rank": rank}).items()}
            out, carry = go(rows, m, last=False)
            if out.num_rows:
                yield out
        if len(carry["token"]):
            yield go(carry, 0, last=True)[0]

    sorted_rows = rows.repartition("token").sortWithinPartitions("token", "size", "node").select("token", "node", "size", "pos", "label")
    return sorted_rows.mapInArrow(pair, "a long, b long, token long, node long, size int, pos int")


def _bitmap(keys: DataFrame, log_bits: int) -> np.ndarray:
    """2 ** log_bits bits that are set for the keys (one long column)."""
    bit = F.pmod(F.col(keys.columns[0]), F.lit(1 << log_bits))
    rows = keys.select(F.floor(bit / 32768).alias("at"), (bit % 32768).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (log_bits - 3), dtype=np.uint8)
    for r in rows:
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _sets(frame: DataFrame, text_hashes: DataFrame, most_bits: int = MOST_BITMAP_BITS) -> DataFrame:
    """node, members (40 bits of each shingle, sorted) of the documents with these text hashes, and few others.

    A bitmap of eight bits or more to a hash tells which documents those are; for more hashes than one can hold, a join."""
    n = text_hashes.count()
    log_bits = max(BITMAP_BITS, (8 * n - 1).bit_length() if n else 0)
    if log_bits > most_bits:
        frame, shared = frame.join(text_hashes.distinct(), "text_hash", "left_semi").select("doc_id", "text", "text_hash"), None
    else:
        shared = frame.sparkSession.sparkContext.broadcast(_bitmap(text_hashes, log_bits))

    def emit(batches):
        known, seen = _Words(), set()
        for batch in arrow_batches(batches):
            if shared is not None:
                bit = batch.column(2).to_numpy() & ((1 << log_bits) - 1)
                batch = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            found, sets = [], []
            for text in utf8(batch.column(1)):
                members = shingles(text, known)
                if not len(members) or (node := node_of(members)) in seen:
                    continue
                seen.add(node)
                found.append(node)
                short = (members >> np.uint64(24)).astype("<u8")
                sets.append(np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])

    return frame.mapInArrow(emit, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


def _members(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


_BOUNDS = (np.arange(1, 16, dtype=np.uint64) << np.uint64(36)).astype(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link. The suffix filter first: in each range of the hash no more than the fewer can be common."""
    need = least_overlap(len(a) + len(b))
    if min(len(a), len(b)) < need:
        return False
    in_a, in_b = (np.diff(np.concatenate(([0], np.searchsorted(x, _BOUNDS), [len(x)]))) for x in (a, b))
    if np.minimum(in_a, in_b).sum() < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _verified(frame: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, as edges u, v. texts: node, text_hash of one document for each node."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(frame, materialise(needed.join(texts, "node").select("text_hash"), "jaccard-needed"))
    with_b = pairs.join(sets, pairs["b"] == sets["node"]).select("a", "b", F.col("members").alias("of_b"))
    both = with_b.join(sets, with_b["a"] == sets["node"]).select("a", "b", "of_b", F.col("members").alias("of_a"))

    def verify(batches):
        for batch in arrow_batches(batches):
            good = [linked(_members(x), _members(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, "u long, v long")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, shared) those that one side or the other shares the most prefix shingles with."""
    sides = pairs.select("a", "b", "shared", F.col("a").alias("node")).union(pairs.select("a", "b", "shared", F.col("b").alias("node")))
    best = sides.groupBy("node").agg(F.max(F.struct("shared", "a", "b")).alias("m"))
    return best.select("m.a", "m.b").distinct()


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that labels don't have in one component."""
    if labels is None:
        return pairs
    la, lb = (labels.select(F.col("node").alias(f"_{x}"), F.col("label").alias(f"_l{x}")) for x in "ab")
    joined = pairs.join(la, pairs["a"] == F.col("_a"), "left").join(lb, pairs["b"] == F.col("_b"), "left")
    return joined.where(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).select("a", "b")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles and component_id (the smallest doc_id reachable by links) by document."""
    return _with_components(*_grouped(docs))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text_hash, node and n by document; and node, label of the nodes that have links (None without any).

    The first round verifies each node's likeliest pairs; the others wait for the next one, where most are in one
    component already. Each later round takes all pairs that are still apart."""
    frame = _frame(docs)
    nodes, frequent = _measured(frame)
    texts = nodes.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    rows = _prefixes(frame, frequent).withColumn("label", F.col("node"))
    labels, links, waiting, low, high = None, None, None, 1, 1
    while True:
        out = None
        if rows is not None:
            out = materialise(_neighbours(rows, low, high), "jaccard-candidates")
            pairs = out.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("shared"))
        if waiting is None:
            pairs = materialise(pairs, "jaccard-pairs")
            chosen = materialise(_likeliest(pairs), "jaccard-chosen")
            waiting = materialise(pairs.select("a", "b").join(chosen, ["a", "b"], "left_anti"), "jaccard-waiting")
        else:
            apart = _apart(waiting, labels)
            chosen = materialise(apart if out is None else apart.union(pairs.select("a", "b")).distinct(), "jaccard-chosen")
            waiting = waiting.limit(0)
        if not chosen.isEmpty():
            new = materialise(_verified(frame, chosen, texts), "jaccard-links")
            links = new if links is None else links.union(new)
            labels = materialise(components(links), "jaccard-labels")
        if out is not None:
            rows = _undecided(out.where("a is null").select("token", "node", "size", "pos"), labels)
            low, high = high + 1, high * STEP
        if rows is None and _apart(waiting, labels).isEmpty():
            return nodes, labels


def _undecided(rows: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """rows with their labels, of the tokens that have more than one; None if there are none."""
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        known = labels.select(F.col("node").alias("_n"), F.col("label").alias("_label"))
        rows = rows.join(known, rows["node"] == F.col("_n"), "left").select("token", "node", "size", "pos", F.coalesce("_label", "node").alias("label"))
    rows = materialise(rows, "jaccard-open")
    several = rows.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("token")
    several = materialise(several, "jaccard-several")
    n = several.count()
    if n == 0:
        return None
    # A large group of near copies has its rows at few tokens: never join them by token alone.
    if n <= BROADCAST_TOKENS:
        mixed = rows.join(F.broadcast(several), "token", "left_semi")
    else:
        salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mixed = rows.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left_semi").drop("salt")
    return materialise(mixed, "jaccard-mixed")


def _with_components(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    least = nodes.where("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least"))
    if labels is not None:
        known = labels.select(F.col("node").alias("_n"), "label")
        labelled = materialise(least.join(known, least["node"] == F.col("_n"), "left").select("node", "least", F.coalesce("label", "node").alias("label")), "jaccard-labelled")
        smallest = materialise(labelled.groupBy("label").agg(F.min("least").alias("smallest")), "jaccard-smallest")
        least = labelled.join(smallest, "label").select("node", F.col("smallest").alias("least"))
    least = materialise(least.select(F.col("node").alias("_n"), "least"), "jaccard-least")
    joined = nodes.join(least, nodes["node"] == F.col("_n"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.nullif("least", F.lit(_NO_ID)))
    return joined.select("doc_id", "node", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group; columns stay, whatever their names.

    The row that stays is the one of the smallest id (null last), of equal ids that of the smaller hash of its text, and
    of rows equal in both any one. Rows without words are in no group and all stay."""
    nodes, labels = _grouped(docs)
    keys = nodes.where("node is not null").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("copies"))
    if labels is None:
        labelled = keys.withColumn("label", F.col("node"))
    else:
        known = labels.select(F.col("node").alias("_n"), F.col("label").alias("_label"))
        labelled = keys.join(known, keys["node"] == F.col("_n"), "left").withColumn("label", F.coalesce("_label", "node"))
    labelled = materialise(labelled.select("doc_id", "text_hash", "copies", "label"), "jaccard-keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    ranked = labelled.join(labelled.groupBy("label").agg(first.alias("best")), "label")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # Most rows are the only one of their group and stay as they are: the keys that don't are joined.
    marked = materialise(ranked.select("doc_id", "text_hash", is_best.alias("stays"), "copies").where("copies > 1 or not stays"), "jaccard-marked")

    text = F.col("text").cast("string")
    rows = wrapped(docs, key_id=F.col("doc_id").cast("long"), key_text=F.xxhash64(text), has_text=text.isNotNull())

    def matches(keys: DataFrame):
        return rows["key_id"].eqNullSafe(keys["doc_id"]) & (rows["key_text"] == keys["text_hash"]) & rows["has_text"]

    kept = rows.join(marked, matches(marked), "left_anti").select("row.*")
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return kept
    one = rows.join(repeated, matches(repeated), "left_semi").groupBy("key_id", "key_text").agg(F.first("row").alias("row"))
    return kept.union(one.select("row.*"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_shingles, component_id by comparing all pairs, for tests."""
    import re

    sets = {}
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + NGRAM]) for i in range(max(1, len(words) - NGRAM + 1))} if words else set()
    component = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if component[a] != component[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = {d: new if c == old else c for d, c in component.items()}
    return [(d, len(sets[d]), component[d]) for d in ids]
