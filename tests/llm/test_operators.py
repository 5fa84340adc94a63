"""Each operator against brute force, on a fixture with nulls, empty and long texts, repeated rows and clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from ledgerloom.llm import common, components, decontaminate, jaccard, likelihood, mixing, pii, quality, queries, repeats, secrets, sharding, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, batch int, size double, word string, _text string, shard int, label string, count long"


def _texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "to", "in"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    passage = prose(60)
    texts = [base, base, " ".join(near), base.upper(), "", None, "   \n\t", "one", "one two three", "one two three", "Été ñandú été ñandú été ñandú", prose(4000), "x" * 60_000, prose(30) + " " + passage + " " + prose(20), passage + "\n" + prose(50)]
    texts += ["mail bob@example.com or +31 20 123 4567, host 10.0.0.1 card 4111 1111 1111 1111. bob (at) site (dot) org", "Token = abcdef123 AKIA" + "A1B2" * 5 + " " + "0a" * 15 + " PASSWORD:\"hunter22\" é secret: x"]
    texts += [f"{prose(15)}\n" * 6, "a b c d", "emoji 😀 text with 😀 marks", prose(80) + " ### $$$ %%%" * 30]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, ("en", "de", None)[i % 3], (f"s{i % 4}" if i % 5 else None), len(t or "")) for i, t in enumerate(texts)]
    return out + [out[0], out[7], (None, texts[0], "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3.0, "w", "_", 4, "l", 5) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=key)


def unique(rows):
    """Rows with an id of their own each, for models that need one."""
    return [(i, r[1]) for i, r in enumerate(rows)]


# 1


def test_decontamination(spark, docs, rows, empty):
    texts = _texts()
    items = [(1, " ".join(texts[11].split()[100:140])), (2, "Two three"), (3, None), (4, ""), (5, "ÉTÉ été"), (None, texts[13]), (2, "Two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force([(r[0], r[1]) for r in rows], [("null" if i is None else i, t) for i, t in items]), key=key)
    assert collected(decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench))) == want
    # The same in several blocks of items, and without any.
    assert collected(decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench, block_bytes=600))) == want
    none = decontaminate.find_contamination(docs, bench.limit(0))
    assert none.where("contaminated or n_hit > 0").isEmpty() and none.count() == len(rows)
    clashing = docs.withColumn("contamination", F.lit("x")).withColumn("Contamination_", F.lit(1)).withColumn("__contamination", F.lit(2))
    assert decontaminate.remove_contaminated(clashing, bench, block_bytes=600).columns == clashing.columns
    assert decontaminate.remove_contaminated(empty, bench).isEmpty()
    kept = decontaminate.remove_contaminated(docs, bench, block_bytes=600)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in want)
    assert decontaminate.find_contamination(empty, bench).isEmpty()


def test_contamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Ünder: A-b, c!! d")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "b C")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench).first()
    assert [("Ünder: A-b, c!! d"[s.start : s.end]) for s in found.char_spans] == ["b, c"] and found["items"] == ["9"]


# 2


def test_sharding(spark, docs, rows, empty):
    got = collected(sharding.compacted(docs, arrival_bytes=5000, fanout=2), *docs.columns)
    assert got == collected(docs, *docs.columns)
    assert sharding.compacted(empty).isEmpty()
    named = docs.select("doc_id", "text", F.lit(1).alias("__arrival"), F.lit("x").alias("file"), F.lit(2).alias("size"))
    assert collected(sharding.compacted(named), *named.columns) == collected(named, *named.columns)


def store_of(spark, docs):
    return sharding.ShardStore(spark, common.scratch(spark, "store"), docs.schema)


def test_shards_are_merged_by_tier(spark, docs):
    store = store_of(spark, docs)
    for _ in range(5):
        store.append(docs)
    assert len(store.runs()) == 5 and store.versions() == [1, 2, 3, 4, 5]
    assert store.compact(fanout=2, small_bytes=1) >= 1
    assert all(len(t) < 2 for t in sharding.tiers(store.runs(), 1)) and store.read().count() == 5 * docs.count()
    assert sum(r.rows for r in store.runs()) == 5 * docs.count()


def test_tiers_have_no_fixed_borders():
    run = lambda n: sharding.Run((str(n),), n, 1)
    around = [run((1 << 20) * k // 10) for k in (8, 9, 10, 11, 12, 13)]
    assert [len(t) for t in sharding.tiers([*around, run(40 << 20), run(50 << 20), run(400 << 20)])] == [6, 2, 1]


def test_production_parameters_merge(spark):
    """Ten arrivals of 8 MB at once, and a merge with nothing but the defaults."""
    docs = spark.range(0, 100_000, 1, 5).select(F.col("id").alias("doc_id"), F.concat(*[F.sha2(F.concat("id", F.lit(str(k))).cast("string"), 512) for k in range(7)]).alias("text"))
    store = store_of(spark, docs)
    store.append(docs, 10, 10_000)
    before = store.runs()
    # Eight of the ten are a merge; two are too few for another.
    assert len(before) == 10 and store.compact() == 1
    assert sorted(r.rows for r in store.runs()) == [10_000, 10_000, 80_000] and store.versions() == [1, 2]


def test_merges_are_bounded_and_fill_tier_after_tier(spark):
    docs = spark.range(0, 640, 1, 2).select(F.col("id").alias("doc_id"), F.concat(*[F.sha2(F.concat("id", F.lit(str(k))).cast("string"), 512) for k in range(16)]).alias("text"))
    store = store_of(spark, docs)
    store.append(docs, 64, 10)
    assert len(store.runs()) == 64
    merged, real = [], store._merge
    store._merge = lambda group, target: merged.append([r.rows for r in group]) or real(group, target)
    assert store.compact(fanout=4, small_bytes=1) == 21
    assert sorted(merged) == sorted([[10] * 4] * 16 + [[40] * 4] * 4 + [[160] * 4]) and [r.rows for r in store.runs()] == [640]
    assert collected(store.read()) == collected(docs)


def test_a_version_is_whole_or_not_there(spark, docs):
    store = store_of(spark, docs)
    store.append(docs)
    runs = store.runs()
    store._write_aside(runs)  # a writer that died before its rename
    assert store.versions() == [1] and store.runs() == runs
    with pytest.raises(sharding.Conflict):
        store._commit(0, [])  # another writer was first
    assert store.versions() == [1] and store.runs() == runs
    # A second writer that saw version 1 adds to version 2.
    other = sharding.ShardStore(spark, store.root, docs.schema)
    seen = []

    def late(live):
        if not seen:
            seen.append(other.append(docs))
        return live + [sharding.Run(("late",), 1, 1)]

    assert store._change(late) == 3 and len(store.runs()) == 3


def test_readers_outlive_compaction(spark, docs):
    store = store_of(spark, docs)
    for _ in range(4):
        store.append(docs)
    reader = store.read()
    assert store.compact(fanout=2) == 3
    store.vacuum(3600)
    assert reader.count() == 4 * docs.count() == store.read(4).count()
    store.vacuum(0)
    assert store.versions() == [7] and store.read().count() == 4 * docs.count()


# 3


def test_jaccard_groups(spark, docs, rows, empty):
    with_ids = spark.createDataFrame(unique(rows), "doc_id long, text string").repartition(3)
    assert collected(jaccard.jaccard_groups(with_ids), "doc_id", "n_shingles", "component_id") == jaccard.brute_force(unique(rows))
    assert jaccard.jaccard_groups(docs).count() == len(rows)
    assert jaccard.jaccard_groups(empty).isEmpty()
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {1, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert jaccard.keep_one(empty).isEmpty()


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near, other = long + " more", " ".join(f"v{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, near), (5, other), (5, near), (None, near), (None, other + " x"), (7, ""), (7, ""), (None, None), (9, "one two"), (9, "one two"), (9, "three four")]
    docs = spark.createDataFrame([(*r, "a", "b", i) for i, r in enumerate(rows)], "doc_id long, text string, _d string, row string, key_id int").repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, long), (5, other), (7, ""), (7, ""), (None, None), (9, "one two"), (9, "three four")]
    assert collected(kept, "doc_id", "text") == sorted(want, key=key)
    # Without any near copies.
    assert collected(jaccard.keep_one(docs.where("text in ('', 'one two', 'three four')")), "doc_id", "text") == sorted([(7, ""), (7, ""), (9, "one two"), (9, "three four")], key=key)


def test_sets_by_join_beyond_the_bitmap(spark):
    frame = jaccard._frame(spark.createDataFrame([(i, f"a b c d e{i} f g") for i in range(20)], "doc_id long, text string"))
    wanted = frame.where("doc_id < 5").select("text_hash")
    joined = {r.node for r in jaccard._sets(frame, wanted, most_bits=0).collect()}
    assert len(joined) == 5 and joined <= {r.node for r in jaccard._sets(frame, wanted).collect()}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_undecided_rows(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_TOKENS", most)
    rows = spark.createDataFrame([(1, 10, 5, 0), (1, 11, 5, 0), (2, 10, 5, 1), (3, 12, 5, 0), (3, 13, 5, 0)], "token long, node long, size int, pos int")
    labels = spark.createDataFrame([(10, 10), (11, 10)], "node long, label long")
    assert collected(jaccard._undecided(rows, labels), "token", "node", "label") == [(3, 12, 12), (3, 13, 13)]
    assert jaccard._undecided(rows.where("token < 3"), labels) is None


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """Groups larger than a step, with members that link to few others only."""
    monkeypatch.setattr(jaccard, "STEP", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"v{rng.randrange(5)}"
        texts.append(" ".join(t))
    data = list(enumerate(texts))
    got = collected(jaccard.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == jaccard.brute_force(data)


def test_components_in_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_PER_TASK", 7)
    edges = [(i, i + 1) for i in range(0, 30) if i != 14] + [(40, 50), (50, 45), (40, 40)]
    got = dict(collected(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: (0 if i <= 14 else 15) for i in range(31)} | {40: 40, 45: 40, 50: 40}


# 4


def test_personal_data(spark, docs, rows, empty):
    found = {(r.doc_id, i): r for i, r in enumerate(pii.find_personal_data(docs).collect())}
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found.values()}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            base = [(s.start, s.kind, s.end) for s in by_id[doc_id].spans if s.finder == "base"]
            assert base == pii.brute_force(text)
    spelled = [(rows[15][1][s.start : s.end]) for s in by_id[15].spans if s.finder == "model"]
    assert spelled == ["bob (at) site (dot) org"]
    assert pii.find_personal_data(empty).isEmpty()
    assert pii.personal_digest(pii.find_personal_data(docs)).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_base_spans_like_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("0159.@a+- ()b%", k=rng.randint(0, 40)))
        assert [(s, pii.KINDS[k], e) for s, k, e in pii.base_spans(text)] == pii.brute_force(text), text


def test_model_on_held_out_texts():
    hits = wrong = missed = 0
    texts = pii.labelled_texts(150, seed=4242)
    tagger = pii.Tagger(pii.trained())
    for (_, spans), found in zip(texts, pii.scan_texts(tagger, [t for t, _ in texts]), strict=True):
        gold, got = set(spans), {(s, k, e) for s, k, e, _ in found}
        hits, wrong, missed = hits + len(gold & got), wrong + len(got - gold), missed + len(gold - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.85
    bare = "bob (at) site (dot) org"
    assert pii.scan_texts(tagger, [bare]) == [[(0, 0, len(bare), "model")]]


def test_windows_are_reconciled(monkeypatch):
    """A span is found wherever windows cut it; windows are read in groups that documents don't end with."""
    monkeypatch.setattr(pii, "TOGETHER", 7)
    tagger, bare = pii.Tagger(pii.trained()), "anna.smith (at) site (dot) org"
    texts = ["the report was sent to us in order " * 3 + "on" * (n // 2) + " " * (n % 2) + ", " + bare + " for the invoice of the office " * 4 for n in range(0, 170)]
    found = sum([(x[s:e]) for s, _, e, f in spans if f == "model"] == [bare] for x, spans in zip(texts, pii.scan_texts(tagger, texts), strict=True))
    assert found >= 0.95 * len(texts)
    assert [list(pii.windows("")), [s for s, _ in pii.windows("a")]] == [[], [-pii.PAD]]
    text = "".join(map(chr, range(33, 120))) * 9
    covered = np.zeros(len(text), dtype=int)
    for start, row in pii.windows(text):
        assert (row[max(0, -start) : len(text) - start] == pii.codes(text[max(start, 0) : start + pii.WINDOW])).all()
        covered[max(start, 0) : start + pii.WINDOW] += 1
    assert covered.min() >= 1


def test_cut_spans_are_put_together():
    seen = [pii._Seen(10, 0, 128, False, True, 0), pii._Seen(80, 0, 208, True, True, 0), pii._Seen(160, 0, 230, True, False, 0), pii._Seen(300, 2, 319, False, False, 9), pii._Seen(305, 3, 319, True, False, 0), pii._Seen(302, 3, 315, False, False, 2)]
    assert sorted(pii._reconciled(seen)) == [(10, 0, 230), (300, 2, 319)]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in pii._initial(1).items()}
    rows, gold = rng.integers(0, pii.N_CHARS, (3, 7)), rng.integers(0, pii.N_TAGS, (3, 7))
    _, gradient = pii._loss_gradient(p, rows, gold)
    for k, v in p.items():
        at = tuple(rng.integers(0, n) for n in v.shape) if k != "embed" else (int(rows[0, 2]), 1)
        losses = []
        for step in (1e-5, -1e-5):
            q = {name: x.copy() for name, x in p.items()}
            q[k][at] += step
            losses.append(pii._loss_gradient(q, rows, gold)[0])
        assert abs((losses[0] - losses[1]) / 2e-5 - gradient[k][at]) < 1e-6, k
    assert np.allclose(pii.Tagger(p).scores(rows).transpose(0, 2, 1), pii.emissions(p, rows)[0], atol=1e-5)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    begin, move, scores = rng.normal(size=pii.N_TAGS), rng.normal(size=(pii.N_TAGS, pii.N_TAGS)), rng.normal(size=(4, pii.N_TAGS, 9))
    scores[:, 0, 5:] += 9  # rows without any span
    got = pii.viterbi(begin.astype(np.float32), move.astype(np.float32), scores.astype(np.float32))
    for r in range(9):
        value = lambda path: begin[path[0]] + sum(scores[t, x, r] for t, x in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert tuple(got[r]) == max(itertools.product(range(pii.N_TAGS), repeat=4), key=value)


# 5


def test_secrets(spark, docs, rows, empty):
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            assert [(s.start, s.kind, s.end) for s in found[doc_id].spans if s.kind in secrets.BASE_KINDS] == secrets.brute_force(text)
    assert secrets.find_secrets(docs).count() == len(rows) and secrets.find_secrets(empty).isEmpty()


def secrets_by_search(text: bytes):
    """All rules' matches that count, by the patterns; their tails are the last class, repeated."""
    out = []
    for k, rule in enumerate(secrets.RULES):
        tail = re.search(r"(\[[^\]]*\])\+$", rule.pattern)
        pattern = rule.pattern[: tail.start()] + f"({tail[1]}+)" if tail else f"({rule.pattern})"
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern.encode(), text) if len(m[1]) >= rule.tail]
    return sorted(out)


@pytest.mark.parametrize("few", [0, 3])
def test_automaton_finds_what_the_rules_match(monkeypatch, few):
    monkeypatch.setattr(secrets, "FEW", few)
    monkeypatch.setattr(secrets, "BLOCK", 90)
    monkeypatch.setattr(secrets, "STRETCH", 16)
    scanner = secrets.Scanner(secrets.RULES, secrets.compile_rules())
    rng = random.Random(2)
    parts = ["token", "TOKEN", "=", ": ", "abcdef", "AKIA", "A1B2C3D4", "0123456789ab", " ", ",", "ghp_", "x" * 36, "-----BEGIN PRIVATE KEY-----", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "eyJhbGci", ".", '"', "api_key", "sk_live_", "xoxb-", "AIza", "\0", "é", " " * 40, "0a" * 30]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 16))).encode()
        assert scanner.scan(text) == secrets_by_search(text), text


def test_long_words_are_read_in_stretches():
    scanner = secrets.Scanner(secrets.RULES, secrets.compile_rules())
    text = b"x" * 3_000_000 + b"token=" + b"y" * 2_000_000 + b" " + b"AKIA" + b"7" * 300_000 + b" token=" + b" " * 500_000 + b"abcdef"
    assert scanner.scan(text) == secrets_by_search(text)


# 6


def test_token_shards(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    encoded = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    for doc_id, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert collected(wavelet.encode_and_read(docs, path, shard_chars=20_000, payload_tokens=900)) == sorted(want, key=key)
    assert wavelet.encode_and_read(empty, path).isEmpty()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_like_the_library(name):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(name), random.Random(6)
    # Letters, closing signs, white space of all kinds, combining marks, letters that normal form C or lower case take
    # apart or put together, special tokens.
    signs = [*"abzAZ'st.,;:!? \t\n\x0b\r\x1c\x85\xa0\x01<|>09#-", *"İıſKéÉßẞŉǰΣσςàñṈ\u0303\u0301\u0307\u0308\u0338", *"\u0915\u0958\u095f\u093cק\u05b4\u05bc\ufb2a\ufb1d\ufb2e", *"Ω中日\u3000\u200b😀"]
    signs += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "T\u0308", "≠", "'S", "'ll", "İ,", "é!"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(100_000)]
    encoder, tokenizer = wavelet._Encoder(path), Tokenizer.from_file(path)
    got = [x for at in range(0, len(texts), 1000) for x in encoder.encode([t.encode() for t in texts[at : at + 1000]])]
    for text, ids, want in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, encoder.width).tolist() == want.ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_words_need_no_marks(name, monkeypatch):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(name), random.Random(61)
    encoder, tokenizer, seen = wavelet._Encoder(path), Tokenizer.from_file(path), []
    whole = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: seen.append(text) or whole(text))
    texts = [" ".join("".join(rng.choices("abcdeXYZ'09#.,", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(100)] + ["Ünïque wörds\x01 é"]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(ids, encoder.width).tolist() for ids in got] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if encoder.lengths is not None:
        # Words of ASCII are cut by their lengths, others by marks between them.
        assert sum(t.isascii() and " \x01 " in t for t in seen) == 0 and any(" \x01 " in t for t in seen)
    assert name != "word_bpe_49k.json" or encoder.lengths is not None


def test_plain_words_go_to_the_model_once(monkeypatch):
    """Words of letters, with closing signs or not, cost no call of the whole tokenizer, and come in whole columns."""
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path("word_bpe_49k.json"), random.Random(62)
    encoder, tokenizer, seen = wavelet._Encoder(path), Tokenizer.from_file(path), []
    encoder.encode([sign.encode() for sign in (".", ",", "!", "%%%")])
    whole = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: seen.append(text) or whole(text))
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(["", "", ".", ",", "!", "%%%"])
    texts = [" ".join(word(letters) for _ in range(50)) for letters in ("abcdefXYZ", "abcdéßñœ") for _ in range(100)] + [None, "", " \n"]
    texts = [*texts, *texts[::-1]]
    encoder.encode([t.encode() for t in texts if t])
    assert not seen
    got = encoder.encode_column(pa.array(["cut off", *texts], pa.string()).slice(1), 7).to_pylist()
    want = [x.ids + [7] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(ids, encoder.width).tolist() for ids in got] == want and not seen
    special = ["a<|endoftext|>b", "é", "<|ENDOFTEXT|>", None]
    want = [x.ids for x in tokenizer.encode_batch([t or "" for t in special], add_special_tokens=False)]
    assert [np.frombuffer(ids, encoder.width).tolist() for ids in encoder.encode_column(pa.array(special)).to_pylist()] == want
    assert seen[:2] == ["a<|endoftext|>b", "<|ENDOFTEXT|>"]


def test_shard_bounds_in_regions(spark):
    ids = spark.createDataFrame([(i * i,) for i in range(2000)] + [(None,)] * 5, "doc_id long")
    bounds = wavelet._bounds(ids, 20, regions=4)
    assert len(bounds) == 19 and max(np.diff(np.sqrt([0, *bounds, 2000**2]))) < 130
    assert len(wavelet._bounds(ids.limit(0), 20, regions=4)) == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((1, 2), (700, 3), (5000, 1000)):
        tokens = rng.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(tokens, max(1, int(tokens.max()).bit_length())).to_bytes())
        assert (m.tokens() == tokens).all()
        for i in rng.integers(0, n, 20).tolist():
            assert m.access(i) == tokens[i]
            t, a = int(tokens[i]), int(rng.integers(0, n))
            assert m.count(t) == (tokens == t).sum() and m.count(t, a, n) == (tokens[a:] == t).sum()
            where = np.flatnonzero(tokens == t)
            k = int(rng.integers(0, len(where)))
            assert m.locate(t, k) == where[k]
    with pytest.raises(IndexError):
        m.locate(10**6, 0)


# 7


def test_repeats(spark, rows, docs, empty, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 5000)
    data = [r for r in unique(rows) if r[1] is None or len(r[1]) < 50_000]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert collected(repeats.repeat_digest(repeats.repeated_spans(frame))) == sorted(repeats.brute_force(data))
    assert repeats.repeated_spans(docs).count() == len(rows)
    assert repeats.repeated_spans(empty).isEmpty()


def test_repeats_of_long_documents(spark, monkeypatch):
    """Documents in pieces, several parts to a task, repeats over the cuts, equal ids and null ids."""
    for name, value in (("BATCH_BYTES", 2000), ("PIECE_BYTES", 1500), ("PART_BYTES", 2000), ("MOST_TASKS", 3)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    shared, long = text(4000), text(5000)
    data = [(0, shared), (1, text(300) + shared[100:3900] + text(90)), (2, long), (3, long[1400:1700] + text(2000) + long[2990:3100]), (4, "ab" * 2500), (5, "ba" * 1000 + text(1500))]
    data += [(6, long[:1499]), (7, long[:1500] + "x"), (8, long[1451:1549]), (9, ""), (10, None), (11, shared[:49]), (12, shared[:50])]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert collected(repeats.repeat_digest(repeats.repeated_spans(frame))) == sorted(repeats.brute_force(data))
    # Equal ids and null ids: rows of equal id are no smaller to each other, null is larger than all.
    odd = spark.createDataFrame([(1, shared), (1, shared), (None, shared), (None, long), (None, long)], "doc_id long, text string")
    n = len(shared.encode())
    assert sorted((r.doc_id is None, r.n_removed) for r in repeats.repeat_digest(repeats.repeated_spans(odd)).collect()) == [(False, 0), (False, 0), (True, 0), (True, 0), (True, n)]


def test_ranks_tell_strings_apart():
    # Strings that polynomials modulo a power of two give one value, whatever the base.
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    both = (thue + thue.translate(str.maketrans("ab", "ba"))).encode()
    ranks = repeats._ranks(np.frombuffer(both, np.uint8))
    strings = [both[i : i + repeats.HALF] for i in range(len(ranks))]
    assert len(set(ranks.tolist())) == len(set(strings)) == len(set(zip(ranks.tolist(), strings, strict=True)))
    assert [len(repeats._ranks(np.zeros(n, np.uint8))) for n in (0, 1, 24, 25, 26)] == [0, 0, 0, 1, 2]


# 8


def test_mixing(spark, docs, rows, empty):
    documents, manifest = mixing.mix(docs, block_words=16)
    got = mixing.taken_by_document(documents, manifest).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    total, taken = Counter(), Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == total[r.source]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weights, bound, done = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3.0 * total[s] for s in names}, {}
    while True:
        left, weight = sum(total.values()) - sum(done.values()), sum(w for s, w in weights.items() if s not in done)
        over = [s for s in names if s not in done and left * weights[s] / weight > bound[s]]
        if not over:
            break
        done |= {s: bound[s] for s in over}
    for r in got:
        assert math.isclose(r.target, done.get(r.source, left * weights[r.source] / weight), rel_tol=1e-9, abs_tol=1e-9)
    for r in got:
        assert abs(taken[r.source] - r.target) <= 1
    again = mixing.taken_by_document(*mixing.mix(docs.repartition(5), block_words=16)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in got)
    mixed = mixing.apply_mix(docs, block_words=16)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixing.apply_mix(empty).isEmpty()
    # Each row comes as often as the mix takes it, rounded up or down.
    share = {}
    for r in got:
        share.setdefault((r.doc_id, r["size"]), []).append(r.taken / r["size"] if r["size"] else 0)
    times = Counter((r.doc_id, size(r.text)) for r in mixed.collect())
    for k, v in share.items():
        assert len(v) * math.floor(sum(v) / len(v) + 1e-9) <= times[k] <= len(v) * math.ceil(sum(v) / len(v) - 1e-9)
    assert mixing.taken_by_document(*mixing.mix(empty)).isEmpty()


@pytest.mark.parametrize("words", [5, 100, 160, 8000])
def test_copies_meet_the_target_at_any_length(spark, words):
    # Sources of which 0.375 and 0.75 are taken; documents of one block, of twenty, and of a thousand.
    n = 6000 // max(words // 8, 8) * 8
    rows = [(i, " ".join(f"w{i}" for _ in range(words)), ("a", "b", "c")[i % 3]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    count = {r.source: r["count"] for r in mixing.apply_mix(docs, block_words=8).groupBy("source").count().collect()}
    for source, target in (("a", n * 5 / 8), ("b", n * 2 / 8), ("c", n / 8)):
        assert abs(count.get(source, 0) - target) <= max(1, 0.02 * target)


def test_copies_of_unlike_lengths_meet_the_target(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([3, 30, 300, 3000]), f"s{rng.randrange(3)}") for i in range(500)] + [(1, "w " * 3000, "s0")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    documents, manifest = mixing.mix(docs, block_words=64)
    target = {r.source: r.target for r in documents.select("source", "target").distinct().collect()}
    words = Counter()
    for r in mixing.apply_mix(docs, block_words=64).collect():
        words[r.source] += len(r.text.split())
    for source, want in target.items():
        assert abs(words[source] - want) <= 3000 * 4


def test_running_sums(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(9), i, rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g int, b int, i int, v long").repartition(5)
    got = {r.i: r.before for r in mixing.running_sums(df, "v", ["k", "g", "b"], ["i"]).collect()}
    for k, g, b, i, _ in rows:
        assert got[i] == sum(v for k2, g2, b2, i2, v in rows if k2 == k and (g2, b2, i2) < (g, b, i))


def test_manifest_is_a_sound_mix(spark, docs):
    """Taken words against the manifest's slots: each epoch takes a block once, whole ones but for the last slot's."""
    documents, manifest = mixing.mix(docs, block_words=16)
    rows, pieces = documents.collect(), manifest.collect()
    order = {}
    for r in rows:
        order.setdefault(r.source, []).append(r)
    taken = Counter()
    for source, own in order.items():
        own.sort(key=lambda r: (r.begin, r["size"]))
        at = 0
        for r in own:  # packed without gaps
            assert r.begin == at
            at += r["size"]
        slots = {}
        for p in (p for p in pieces if p.source == source):
            start, end = p.begin + p.first, p.begin + p.last
            assert p.block * 16 <= start < end <= min(at, (p.block + 1) * 16)
            slots.setdefault((p.epoch, p.slot, p.block), []).append((start, end))
            taken[source, p.begin, p.doc_id, p.row_hash] += end - start
        epochs = Counter((e, b) for e, _, b in slots)
        assert not slots or max(epochs.values()) == 1
        lengths = {}
        for (epoch, slot, block), spans in slots.items():
            spans.sort()
            assert spans[0][0] == block * 16 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
            lengths[slot] = (spans[-1][1] - block * 16, min(16, at - block * 16))
        # Only the last slot may take a part of its block, and only the last epoch leaves blocks out.
        assert all(n == full for slot, (n, full) in lengths.items() if slot != max(lengths))
        n_blocks = -(-at // 16)
        per_epoch = Counter(e for e, _, _ in slots)
        assert all(n == n_blocks for e, n in per_epoch.items() if e != max(per_epoch))
    for r in mixing.taken_by_document(documents, manifest).collect():
        want = taken[r.source, r.begin, r.doc_id, r.row_hash] if r["size"] else 0
        assert r.taken == want


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select("id", mixing._permuted(F.col("id"), F.lit(n), F.lit(3), 1).alias("p"))
        df = df.withColumn("back", mixing._permuted(F.col("p"), F.lit(n), F.lit(3), 1, inverse=True))
        got = df.collect()
        assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)


# 9


def base_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality(docs, rows, empty):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.quality_report(docs)
    assert collected(got, "doc_id", *columns) == sorted(((r[0], *base_quality(r[1])) for r in rows), key=key)
    assert got.where("base_failed and kept").isEmpty()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count() > 0
    assert quality.quality_report(empty).isEmpty()


def js_distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda v: sum(a * math.log2(a / b) for a, b in zip(v, m, strict=True) if a)
    return math.sqrt(max((kl(p) + kl(q)) / 2, 0.0))


def test_verdicts_like_a_plain_model(spark, docs, rows):
    def folded(text):
        plain = regex.sub(r"[^\p{L}\x20\x09-\x0d]+", "", (text or "").lower())
        words = re.findall("[^\x20\x09-\x0d]+", plain)
        counts = Counter(words)
        return [*(counts[w] for w in quality.VOCABULARY), len(words) - sum(counts[w] for w in quality.VOCABULARY)]

    def classes(text):
        text = text or ""
        letters, digits, space = len(regex.findall(r"\p{L}", text)), len(re.findall("[0-9]", text)), len(re.findall(r"[\x20\x09-\x0d]", text))
        points = len(re.findall(r"[.,;:!?'\"()\-]", text))
        return [letters, digits, space, points, len(text) - letters - digits - space - points]

    lang = lambda r: r[2] if r[2] in quality.WORD_SHARES else quality.REST
    own = {}
    for r in rows:
        own[lang(r)] = [a + b for a, b in zip(own.get(lang(r), [0] * (len(quality.VOCABULARY) + 1)), folded(r[1]), strict=True)]
    kept = []
    for r in rows:
        *_, failed = base_quality(r[1])
        counts, reference = folded(r[1]), own[lang(r)] if lang(r) != quality.REST else None
        near = (js_distance(classes(r[1]), quality.CLASS_SHARES[lang(r)]) or 0) <= quality.MAX_CLASS_DISTANCE
        if reference and sum(counts):
            share = 1 - reference[-1] / sum(reference)
            without = js_distance([0] * len(quality.VOCABULARY) + [1], reference)
            if share:
                near = near and js_distance(counts, reference) <= without * (quality.MAX_WORD_SHARE + quality.WORD_SLACK / (sum(counts) * share))
        chars = sum(map(len, re.findall("[^\x20\x09-\x0d]+", r[1] or "")))
        kept.append((r[0], not failed and (chars < quality.MIN_CHARS or near)))
    assert collected(quality.quality_report(docs), "doc_id", "kept") == sorted(kept, key=key)
    assert {k for _, k in kept} == {True, False}


def test_divergence_separates(spark):
    good = "the report of the day is that a man in the town was to go for it with the rest of us and to stay in a house that is old " * 3
    words = [w for i, w in enumerate(good.split())]
    random.Random(0).shuffle(words)
    rows = [(1, " ".join(words), "en"), (2, " ".join(w + "$$$%%%" for w in words), "en"), (3, " ".join(words).upper(), "en")]
    got = {r.doc_id: (r.base_failed, r.class_distance, r.word_distance) for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1][1] < quality.MAX_CLASS_DISTANCE < got[2][1] and got[1][2] != got[3][2]
    learned = quality.references(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string"))
    same = quality.quality_report(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string"), learned).first()
    assert same.class_distance < 1e-6 and same.word_distance < 1e-6


def test_common_words_reject(spark):
    rng = random.Random(8)
    letters = lambda: "".join(rng.choices("bcfghjkmnpqrtvwxz", k=rng.randint(3, 9)))
    rare = {lang: [letters() for _ in range(2000)] for lang in quality.WORD_SHARES}

    def prose(lang, n):
        common = rng.choices(list(quality.WORD_SHARES[lang]), [*quality.WORD_SHARES[lang].values()], k=n)
        words = [c if rng.random() < 0.25 else rng.choice(rare[lang]) for c in common]
        return " ".join(w.capitalize() + "," if i % 9 == 0 else w for i, w in enumerate(words))

    good = [(i, prose(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in quality.WORD_SHARES for n in (50, 80, 150, 400, 900) for _ in range(10))]
    bad = [(1000, " ".join(letters() for _ in range(300)), "en"), (1001, prose("en", 300), "de"), (1002, prose("de", 300), "fr"), (1003, prose("es", 900), "fr")]
    rows = [*good, *bad, (2000, prose("en", 400).upper(), "en")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept & {r[0] for r in bad} == set()
    assert kept == {r[0] for r in good} | {2000}


# 10


def test_likelihood(spark, docs, rows, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    got = likelihood.score(docs, path, frequent_words=20)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    counts = Counter(w for d, ws in words if not out(d) for w in ws)
    ends = sum(not out(d) for d, _ in words)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 1) / (total + distinct + 1))
    want = sorted(((d, out(d), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total, round(sum(log(counts[w]) for w in ws) + log(ends), 5)) for d, ws in words), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.collect()), key=key)
    assert have == want
    assert got.where("score >= 0 or score is null").isEmpty()
    assert likelihood.score(empty, path).isEmpty()


def test_scores_like_a_plain_model(spark, docs, rows):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows if r[1] is None or len(r[1]) < 50_000]
    small = docs.where("text is null or length(text) < 50000")
    train = Counter(w for d, ws in words if not out(d) for w in ws)
    counts, ends = Counter(), sum(not out(d) for d, _ in words)
    for w, n in train.items():
        for piece in model.encode(w.decode()):
            counts[piece] += n
    size = model.get_piece_size()
    total = sum(counts.values()) + ends + size + 1
    log = lambda n: math.log10((n + 1) / total)
    by_piece = {model.id_to_piece(i): log(counts[i]) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    by_byte = [log(counts[model.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]

    def word_score(word):
        """Sums probabilities themselves, from the end of the word."""
        text = "▁" + word.decode()
        rest = [0.0] * len(text) + [1.0]
        for i in reversed(range(len(text))):
            for j in range(i + 1, len(text) + 1):
                score = by_piece.get(text[i:j], sum(by_byte[b] for b in text[i].encode()) if j == i + 1 and text[i] not in by_piece else None)
                rest[i] += 10**score * rest[j] if score is not None else 0.0
        return math.log10(rest[0])

    known = {w: word_score(w) for _, ws in words for w in ws}
    want = sorted(((d, round(sum(known[w] for w in ws) + log(ends), 4)) for d, ws in words), key=key)
    have = sorted(((r.doc_id, round(r.score, 4)) for r in likelihood.score(small, path, frequent_words=20).collect()), key=key)
    assert [d for d, _ in have] == [d for d, _ in want] and all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(have, want, strict=True))


def test_forward_sums_all_segmentations():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, "▁a": -1.2, "▁ab": -3.0}
    by_byte = [-5.0] * 256

    def every(text):
        if not text:
            return [0.0]
        out = []
        for i in range(1, len(text) + 1):
            s = pieces.get(text[:i], sum(by_byte[b] for b in text.encode()[:i]) if i == 1 and text[0] not in pieces else None)
            if s is not None:
                out += [s + rest for rest in every(text[i:])]
        return out

    for word in ("ab", "aab", "abba", "b", ""):
        assert math.isclose(likelihood.forward(word, pieces, by_byte, 3), math.log(sum(map(math.exp, every("▁" + word)))))
    assert math.isclose(likelihood.forward("é", pieces, by_byte, 3), -2.0 - 10.0)


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(300)] + [(999, 5000)], "k long, n long")
    got = common.most_frequent(df, "n", 10).collect()
    assert {r.n for r in got} == {5000, 99, 98, 97} and len(got) == 10
    assert common.most_frequent(df.limit(0), "n", 10).isEmpty()
