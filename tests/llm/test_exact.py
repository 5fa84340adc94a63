"""Exact duplicates against brute force, over arrivals and lost writers."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, exact

SCHEMA = "doc_id long, text string, digest string, row int, arrival string, number long, group_size int, found string"
TEXTS = ["a b", "a  b", "a\t\x0b b", " a b", "a b ", "", None, "\n", "x" * 300_000, "x" * 300_000, "é é", "é é", "A b"]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "d", 1, "a", 2, 3, "f") for i, t in pairs], SCHEMA).repartition(3)


def model(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).hexdigest()].append(i)
    order = lambda i: (i is None, i or 0)
    return sorted(((*order(i), *order(min(ids, key=order)), len(ids), k == 0, h) for h, ids in groups.items() for k, i in enumerate(sorted(ids, key=order))))


def found(df):
    order = lambda i: (i is None, i or 0)
    return sorted((*order(r.doc_id), *order(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def pairs():
    return [(k, TEXTS[k % len(TEXTS)]) for k in range(40)] + [(5, None), (7, "\n"), (7, "\n"), (None, "a b"), (None, "lone"), (None, "lone")]


@pytest.mark.parametrize("heavy", [1, 20, 1000])
def test_rows_and_groups(spark, pairs, heavy, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY_SHARE", heavy)
    assert found(exact.deduplicate(frame(spark, pairs))) == model(pairs)


def test_empty_table(spark):
    assert exact.deduplicate(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert found(exact.deduplicate(frame(spark, [(None, None)]))) == model([(None, None)])


def test_arrivals_of_an_index(spark, pairs):
    root = common.scratch(spark, "index")
    index = exact.DigestIndex.create(spark, root, 10)
    with pytest.raises(FileExistsError):
        exact.DigestIndex.create(spark, root)
    first, second = index.new_documents(frame(spark, pairs[:15])), index.new_documents(frame(spark, pairs[15:]))
    assert first.columns == frame(spark, pairs[:1]).columns
    held = {re.sub(r"[ \t-\r]+", " ", t or "") for _, t in pairs[:15]}
    assert sorted(r.doc_id for r in first.collect()) == sorted({re.sub(r"[ \t-\r]+", " ", t or ""): i for i, t in reversed(pairs[:15])}.values())
    kept = second.collect()
    assert [r.text for r in kept] == ["lone"] and "lone" not in held
    # Found again in its folder, and copied to other buckets.
    again = exact.DigestIndex.open(spark, root)
    assert again.new_documents(frame(spark, pairs)).isEmpty() and index.new_documents(frame(spark, pairs).limit(0)).isEmpty()
    copy = index.rebucketed(common.scratch(spark, "index"), 3)
    assert sorted(map(tuple, copy.entries().collect())) == sorted(map(tuple, index.entries().collect()))
    assert copy.new_documents(frame(spark, [(1, "a b"), (2, "new")])).select("doc_id").collect() == [(2,)]


def test_rows_of_a_lost_writer_do_not_count(spark, monkeypatch):
    index = exact.DigestIndex.create(spark, common.scratch(spark, "index"), 10)
    index.new_documents(frame(spark, [(1, "a")]))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(exact, "publish", die)
        index.new_documents(frame(spark, [(2, "b")]))
    assert [r.doc_id for r in index.new_documents(frame(spark, [(3, "b"), (4, "a")])).collect()] == [3]
    # A writer whose number was taken joins again, to what the other one wrote.
    real, raced = exact.publish, []

    def late(*args):
        if not raced:
            raced.append(1)
            index.new_documents(frame(spark, [(5, "c")]))
            return False
        return real(*args)

    monkeypatch.setattr(exact, "publish", late)
    assert [r.doc_id for r in index.new_documents(frame(spark, [(6, "c"), (7, "d")])).collect()] == [7]
    assert index.entries().count() == 4 and index.entries().where("doc_id = 6").isEmpty()


def test_index_buckets_are_not_shuffled(spark):
    index = exact.DigestIndex.create(spark, common.scratch(spark, "index"), 10)
    index.new_documents(frame(spark, [(1, "a")]))
    groups = exact.digests(frame(spark, [(2, "b")])).groupBy("digest").agg(F.min("row"))
    plan = groups.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SortMergeJoin" in physical and "Bucketed: true" in physical and physical.count("Exchange hashpartitioning") == 1
