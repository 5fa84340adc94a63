"""Collocations against brute force, whatever the sizes of shards, pieces and ranges."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, a int, rest string, shard string, n long"


def model(docs, depth=phrases.DEPTH, least=10, most=2000):
    counts = defaultdict(Counter)
    for _, text, lang in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, depth + 1):
                for i in range(len(ws) - k + 1):
                    counts["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "of", "a", "New", "york", "\x01", "a\x01", "été", "x" * 50, "…", "THE"]
    sentence = lambda: " ".join(rng.choices(words, weights=[9, 5, 5, 3, 3, 2, 2, 2, 1, 1, 2], k=rng.randint(0, 25))) + rng.choice([". ", "\n", "\t", "! ?", " "])
    out = [(i, "".join(sentence() for _ in range(rng.randint(0, 6))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(150)]
    return out + [(1, None, "en"), (2, "", None), (3, "  \t\n", "de"), out[0], out[0], (None, "word " * 3000, "fr"), (5, "same pair here. " * 400, None)]


def found(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "p", 1, "r", "s", 2) for i, t, lang in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases(spark, rows):
    want = model(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_small_shards_pieces_and_ranges(spark, rows, monkeypatch):
    for name, value in {"TRIE_BYTES": 3000, "PIECE_NODES": 40, "RANGE_NODES": 90, "FAN_IN": 3, "SET_RANGES": 4, "MOST_KEYS": 30, "HEAVY_SHARE": 10}.items():
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows) == model(rows)


def test_best_of_each_language_only(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_PHRASES", 7)
    assert found(spark, rows) == model(rows, most=7)


def test_no_words(spark):
    assert found(spark, [(1, None, "en"), (2, " . ", None)]) == []
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
