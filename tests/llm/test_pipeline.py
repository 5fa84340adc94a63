"""The pipeline's stages, each against brute force over what its predecessor kept."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, jaccard, mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    columns = kept["documents"].columns
    assert all(set(df.columns) == set(columns) for df in kept.values())
    verdicts = quality.quality_report(kept["documents"]).where("kept")
    assert ids(kept["quality"]) == ids(verdicts)
    groups = jaccard.brute_force([(r.doc_id, r.text) for r in kept["quality"].collect()])
    assert set(ids(kept["near_copies"])) == {c for _, _, c in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = decontaminate.brute_force([(r.doc_id, r.text) for r in kept["near_copies"].collect()], items)
    assert set(ids(kept["decontaminate"])) == {r[0] for r in clean if not r[5]}


def test_mix_and_shards(spark, kept):
    taken = mixing.taken_by_document(*mixing.mix(kept["decontaminate"])).where("size > 0").collect()
    got = ids(kept["mix"])
    assert set(got) <= {r.doc_id for r in taken} and max(got.values()) <= 3
    words, target, largest = Counter(), {}, Counter()
    for r in taken:
        share = r.taken / r["size"]
        assert math.floor(share) <= got[r.doc_id] <= math.ceil(share)
        words[r.source] += got[r.doc_id] * r["size"]
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r["size"])
    for source in target:
        assert abs(words[source] - target[source]) <= largest[source] + 1
    columns = kept["mix"].columns
    rows = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    assert rows(kept["shard"]) == rows(kept["mix"])


PROSE = "the report of the day is that a man in the town was to go for it with the rest of us and to stay in a house that is old"


def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns with names that operators use."""
    rng = random.Random(1)
    prose = [" ".join(rng.sample(PROSE.split() * 4, 90)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(prose)]
    rows += [rows[0], rows[3], (4, prose[5], "en", "s1"), (None, prose[6] + " x", "en", "s2"), (None, prose[7][:-3], None, None), (40, prose[8] + " new words", "en", None)]
    rows += [(41, "", "en", "s1"), (42, None, "en", "s1"), (None, None, None, None), (43, " ".join(rng.choices(PROSE.split(), k=60_000)), "en", "s3")]
    return [(*r, "t", 2, 3.0, 4, 5, "c", 6) for r in rows]


ODD = "doc_id long, text string, lang string, source string, _row string, size int, target double, _d int, __arrival int, contamination string, key_id int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    rows, all_rows = [tuple(r) for r in got.collect()], Counter(odd_rows())
    assert set(rows) <= set(all_rows)
    counts, texts = Counter(rows), [r[1] for r in rows]
    if name == "shard":
        assert counts == all_rows
    if name in ("quality", "decontaminate"):
        # Decided row by row: of equal rows all stay or none.
        assert all(counts[r] in (0, n) for r, n in all_rows.items())
    if name == "quality":
        assert "" not in texts and None not in texts and sum(r[0] == 43 for r in rows) <= 1
    if name == "decontaminate":
        assert texts.count(None) == 2 and texts.count("") == 1
    if name == "near_copies":
        # One of each group by the brute force, and all rows without words.
        groups = {c for _, n, c in jaccard.brute_force(list(enumerate(r[1] for r in odd_rows()))) if n}
        assert sum(1 for t in texts if t) == len(groups) and texts.count(None) == 2 and texts.count("") == 1
        assert max(Counter(t for t in texts if t).values()) == 1
    if name == "mix":
        assert "" not in texts and None not in texts and all(n <= 3 * all_rows[r] for r, n in counts.items())
    assert stage(spark, spark.createDataFrame([], ODD), SF).isEmpty()


def test_texts_are_untouched(kept):
    texts = {r.doc_id: r.text for r in kept["documents"].collect()}
    assert all(texts[r.doc_id] == r.text for r in kept["shard"].collect())
    assert kept["shard"].where(F.col("text").isNull()).isEmpty()
    assert not [t for t in texts.values() if t is not None and not isinstance(t, str)]
