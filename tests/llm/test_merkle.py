"""Merkle proofs against a plain model that walks whole trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, run int, leaf string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """The root, and each leaf's (before, after) by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0] if nodes else None, paths


def model(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, digest, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(*r[:4], text)
            for before, after in path + top:
                folded = h(before, folded, after)
            out.append((str(r[0]), digest, trees[s][0], root, h(*[b + a for b, a in path + top]), folded, folded == root))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, n, 1, 2, "l", "r") for i, s, lang, n, t in rows], SCHEMA).repartition(3)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in merkle.manifest(df).select(columns).collect())


ODD = [(None, None, None, None, None), (None, "s", "", 0, ""), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "B"), (8, "", "en", None, "É" * 40_000), (9, "lone", "x", 3, "Abc")]


@pytest.fixture(scope="module")
def rows():
    big = [(3 * i, "big", "en", i, f"Text {i} OF {i % 9}") for i in range(700)]
    return big + [(10_000 + i, f"s{i:03d}", None, i, "T" * (i % 5)) for i in range(40)] + [(-i, "s", "de", i, None if i % 7 == 0 else "É Q") for i in range(1, 30)] + ODD


def test_proofs(spark, rows):
    got = found(spark, rows)
    assert got == model(rows) and {v for *_, v in got} == {True, False}


def test_copies_of_upper_runs_for_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_SHIFT", 2)
    assert found(spark, rows) == model(rows)


@pytest.mark.parametrize("n", [1, 16, 17])
def test_sizes_of_trees(spark, n):
    few = [(i, "s", "en", 1, "A") for i in range(n)]
    assert found(spark, few) == model(few)


def test_few_rows(spark):
    assert found(spark, ODD[:1]) == model(ODD[:1])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
