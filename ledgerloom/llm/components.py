"""Connected components of an undirected graph given as edges, without gathering the graph anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise

#: Edges that one task contracts by itself at most.
EDGES_PER_TASK = 500_000


def _contract(batches):
    """Union-find over a partition's edges; gives each node but the roots its smallest reachable node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in arrow_batches(batches):
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction: link u's larger (or smaller) neighbours to the smallest of all."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(smallest, "u")
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (columns u, v: long), label being the smallest node of the component.

    Repeated edges and loops change nothing; edges with a null end are not allowed; no edges give no rows; other columns are
    ignored. Each partition of a bounded number of edges is contracted by itself; if there are several, star steps go on
    until nothing changes, with the edges written to the shared folder after each round."""
    edges = materialise(edges.select("u", "v").where("u <> v"), "edges")
    n = edges.count()
    if n == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    parts = -(-n // EDGES_PER_TASK)
    forest = materialise(edges.repartition(parts).mapInArrow(_contract, "u long, v long"), "forest")
    if parts > 1:
        before = None
        while True:
            forest = materialise(_star(_star(forest, True), False), "forest")
            state = forest.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    # Every other node now points at its root; roots point at themselves.
    return forest.select(F.col("u").alias("node"), F.col("v").alias("label")).union(forest.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
