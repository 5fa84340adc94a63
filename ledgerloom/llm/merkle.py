"""Merkle manifest of a table, with proofs by coordinates.

Each row is a leaf, H of its fields; per source the leaves ascend by doc_id and every `GROUP` consecutive nodes (the last run
has what is left) become their H until one is left, the source's subroot; the subroots, by source, give the root in the same
way. H is the SHA-256 of the inputs put one after the other, digests as hex text.

The tree is a table of runs: (tree, level, run) with the digests of the run's up to GROUP nodes. A proof needs, at each level,
the other nodes of the run that the leaf's ancestor is in, and both their coordinates and the ancestor's place follow from the
leaf's index and the source's size alone: at level l the ancestor is node index >> 4l, of the run index >> 4(l+1), and there are
as many levels as powers of GROUP below the size. So leaves explode the coordinates of what they need, join the table of
runs, order what they get by level, put it one after the other, and fold it with their digest. The leaves of a run need the
same runs on all levels above, so coordinates are exploded and looked up once for each run of leaves.

Scale: rows are hashed where they are; only digests are shuffled. Indexes come from one sort by (source, doc_id), whose
partitions' counts are summed, so a source of any size is dealt over many tasks. The upper runs of a large source are asked for
by all its leaves; the table has a copy of these for each `BLOCK` of runs of leaves (under one copy for each 4,096 leaves and
level), so no key of the join has more than BLOCK rows. Each level is written to the shared folder.

Defined results: null fields count as `-`, an empty text as `0:`; a null source is a source, the first; null ids come first in
their source, and rows of the same id are ordered by their leaf, so that equal rows get proofs of their own; texts are hashed
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Nodes of a run, as a power of two; the contract's 16.
SHIFT = 4
GROUP = 1 << SHIFT
#: Runs of leaves that share a copy of the runs above, as a power of two.
BLOCK_SHIFT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: GROUP ** (MOST_LEVELS - 1) is the largest power that a long holds.
MOST_LEVELS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hexes(digests: Column) -> Column:
    """The digests of an array as hex text, one after the other."""
    return F.array_join(F.transform(digests, _hex), "")


def leaf(fields: dict[str, Column]) -> Column:
    """H of the fields, each as its byte count, a colon and its value, or `-` if null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return _h(*[part(fields[f]) for f in FIELDS])


def levels(n: Column) -> Column:
    """Levels of runs in a tree of n leaves: none for a lone leaf."""
    return sum((n > GROUP**k).cast("int") for k in range(MOST_LEVELS))


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with `name`, each row's place (from 0) in the order of `by`: one range sort, whose partitions' counts are summed."""
    place = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    before, at = [], 0
    # A row for each partition of the sort.
    for r in place.groupBy(F.shiftright("_place", 33).alias("part")).count().orderBy("part").collect():
        before.append((r["part"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    local = F.col("_place").bitwiseAND((1 << 33) - 1)
    return place.join(F.broadcast(starts), F.shiftright("_place", 33) == F.col("_part")).withColumn(name, F.col("_start") + local).drop("_place", "_part", "_start")


class Forest:
    """Runs of all levels over trees of leaves, and the trees' roots.

    runs: tree, n (the tree's leaves), level, run, digests; roots: tree, root."""

    def __init__(self, leaf_runs: DataFrame) -> None:
        """leaf_runs: tree, n, run, digests, in a table; trees have all their runs."""
        at = leaf_runs.select("tree", "n", F.lit(0).alias("level"), "run", "digests")
        lone = at.where("n = 1").select("tree", F.col("digests")[0].alias("root"))
        self.depth = at.agg(F.coalesce(F.max(levels(F.col("n"))), F.lit(0))).first()[0]
        runs, roots = [at], [lone]
        for level in range(self.depth):
            nodes = at.where("n > 1").select("tree", "n", F.col("run").alias("node"), F.unhex(F.sha2(_hexes(F.col("digests")), 256)).alias("digest"))
            roots.append(nodes.where(levels(F.col("n")) == level + 1).select("tree", F.col("digest").alias("root")))
            if level + 1 < self.depth:
                above = nodes.where(levels(F.col("n")) > level + 1).groupBy("tree", "n", F.shiftright("node", SHIFT).alias("run"))
                digests = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
                at = materialise(above.agg(digests.alias("digests")).select("tree", "n", F.lit(level + 1).alias("level"), "run", "digests"), "runs")
                runs.append(at)
        self.runs, self.roots = reduce(DataFrame.union, runs), reduce(DataFrame.union, roots)

    def _for_blocks(self) -> DataFrame:
        """The runs above the lowest, each for the blocks of runs of leaves that lie below it."""
        n_runs = F.shiftright(F.col("n") + (GROUP - 1), SHIFT)
        first = F.expr(f"shiftleft(run, {SHIFT} * level)")
        last = F.least(F.expr(f"shiftleft(run + 1, {SHIFT} * level)"), n_runs) - 1
        blocks = F.sequence(F.shiftright(first, BLOCK_SHIFT), F.shiftright(last, BLOCK_SHIFT))
        return self.runs.where("level > 0").select("tree", "level", "run", F.explode(blocks).alias("block"), "digests")

    def above(self, leaf_runs: DataFrame) -> DataFrame:
        """tree, run, steps (own place and digests of the run, by level) for the levels above each run of leaves."""
        level = F.explode(F.sequence(F.lit(1), levels(F.col("n")) - 1)).alias("level")
        ask = leaf_runs.where(levels(F.col("n")) > 1).select("tree", F.col("run").alias("leaf_run"), level)
        ancestor = F.expr(f"shiftright(leaf_run, {SHIFT} * (level - 1))")
        ask = ask.select("tree", "leaf_run", "level", F.shiftright(ancestor, SHIFT).alias("run"), ancestor.bitwiseAND(GROUP - 1).cast("int").alias("own"), F.shiftright("leaf_run", BLOCK_SHIFT).alias("block"))
        got = ask.join(self._for_blocks(), ["tree", "level", "run", "block"])
        steps = F.sort_array(F.collect_list(F.struct("level", "own", "digests")))
        return got.groupBy("tree", F.col("leaf_run").alias("run")).agg(F.transform(steps, lambda s: F.struct(s["own"].alias("own"), s["digests"].alias("digests"))).alias("steps"))


_STEPS = "array<struct<own:int,digests:array<binary>>>"


def _halves(step: Column) -> Column:
    """The digests before and after a step's own node, as text."""
    own, digests = step["own"], step["digests"]
    return F.struct(_hexes(F.slice(digests, 1, own)).alias("left"), _hexes(F.slice(digests, own + 2, GROUP)).alias("right"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs.

    folded_root takes the leaf of the tampered row, where crc32 of the id divides by five, and the siblings as they were."""
    fields = {f: F.col(f) for f in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf(fields | {"text": F.translate("text", _UPPER, _LOWER)})
    leaves = docs.select(
        "doc_id", F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"),
        F.unhex(leaf(fields)).alias("leaf"), F.unhex(F.when(tampered, changed)).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )
    # The row's number only spreads equal rows over partitions; hashes are made once.
    leaves = numbered(materialise(leaves, "leaves"), ["named", "source", "doc_id", "leaf", "row"], "at")
    leaves = materialise(leaves.withColumn("part", F.spark_partition_id()).drop("row"), "leaves")

    spans = leaves.groupBy("named", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = materialise(numbered(spans, ["first"], "tree"), "trees")
    # A part of a source in a partition is a key, so that no source is gathered.
    parts = leaves.select("part", "named", "source").distinct().join(trees, ["named", "source"])
    placed = leaves.join(parts, ["part", "named", "source"]).select("tree", "n", (F.col("at") - F.col("first")).alias("node"), "doc_id", "leaf", "tampered")
    members = F.sort_array(F.collect_list(F.struct("node", "doc_id", "leaf", "tampered")))
    groups = placed.groupBy("tree", "n", F.shiftright("node", SHIFT).alias("run")).agg(members.alias("members"))
    groups = materialise(groups.withColumn("digests", F.transform("members", lambda m: m["leaf"])), "leaf-runs")

    forest = Forest(groups)
    subroots = materialise(forest.roots, "subroots")
    n_trees = subroots.count()
    of_trees = subroots.groupBy(F.shiftright("tree", SHIFT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("tree", "root"))).alias("members"))
    of_trees = materialise(of_trees.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), "run", "members", F.transform("members", lambda m: m["root"]).alias("digests")), "subroot-runs")
    top = Forest(of_trees)

    # What each tree's proofs have in common: its place among the subroots, and the runs above that.
    none = F.array().cast(_STEPS)
    common = of_trees.join(top.above(of_trees), ["tree", "run"], "left").select("n", "digests", "steps", F.posexplode("members").alias("own", "member"))
    own = F.when(F.col("n") > 1, F.array(F.struct("own", "digests")).cast(_STEPS)).otherwise(none)
    common = common.select(F.col("member.tree").alias("tree"), F.col("member.root").alias("subroot"), F.concat(own, F.coalesce("steps", none)).alias("top_steps"))
    root = top.roots.select(_hex(F.col("root"))).first()  # one row, none if there are no trees
    n_blocks = F.shiftright(F.shiftright(F.col("n") + (GROUP - 1), SHIFT) - 1, BLOCK_SHIFT)
    common = common.join(trees.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks)).alias("block")), "tree")

    path = groups.join(forest.above(groups), ["tree", "run"], "left").withColumn("block", F.shiftright("run", BLOCK_SHIFT)).join(common, ["tree", "block"])
    upper = F.transform(F.concat(F.coalesce("steps", none), "top_steps"), _halves)
    path = path.select("n", "members", "digests", _hex(F.col("subroot")).alias("subroot"), upper.alias("upper"))
    upper_text = F.array_join(F.transform("upper", lambda p: F.concat(p["left"], p["right"])), "")
    path = path.select("n", "digests", "subroot", "upper", upper_text.alias("upper_text"), F.posexplode("members").alias("own", "member"))
    path = path.withColumn("first", _halves(F.struct("own", "digests")))
    start = _hex(F.coalesce("member.tampered", "member.leaf"))
    # A lone leaf is its subroot; any other is first put among its run.
    in_run = F.when(F.col("n") == 1, start).otherwise(_h(F.col("first.left"), start, F.col("first.right")))
    folded = F.aggregate("upper", in_run, lambda acc, p: _h(p["left"], acc, p["right"]))
    return path.select(
        F.col("member.doc_id").alias("doc_id"), _hex(F.col("member.leaf")).alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        _h(F.col("first.left"), F.col("first.right"), F.col("upper_text")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda crc, b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, b)), 4294967295)) % 5 = 0
      THEN sha256(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, node, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, node // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY node))
  FROM nodes WHERE n > 1 GROUP BY tree, level, node // 16),
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS node, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, node // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY node)) FROM top WHERE n > 1 GROUP BY level, node // 16),
steps AS (
  SELECT p.tree, p.node, o.level, coalesce(string_agg(x.digest, '' ORDER BY x.node) FILTER (x.node < o.node), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.node) FILTER (x.node > o.node), '') AS after
  FROM placed p JOIN nodes o ON o.tree = p.tree AND o.node = p.node >> (4 * o.level)::BIGINT AND o.n > 1
    JOIN nodes x ON x.tree = p.tree AND x.level = o.level AND x.node // 16 = o.node // 16
  GROUP BY ALL),
top_steps AS (
  SELECT s.tree, 100 + o.level AS level, coalesce(string_agg(x.digest, '' ORDER BY x.node) FILTER (x.node < o.node), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.node) FILTER (x.node > o.node), '') AS after
  FROM subroots s JOIN top o ON o.node = s.tree >> (4 * o.level)::BIGINT AND o.n > 1 JOIN top x ON x.level = o.level AND x.node // 16 = o.node // 16
  GROUP BY s.tree, o.level, o.node),
every AS (
  SELECT * FROM steps UNION ALL SELECT p.tree, p.node, t.level, t.before, t.after FROM placed p JOIN top_steps t USING (tree)),
proofs AS (SELECT tree, node, list({'before': before, 'after': after} ORDER BY level) AS steps FROM every GROUP BY tree, node),
folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(f.steps, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
    list_reduce(coalesce(list_transform(f.steps, lambda x: [x.before, x.after]), []), lambda acc, x: [sha256(x[1] || acc[1] || x[2])], [coalesce(p.tampered, p.leaf)])[1] AS folded_root
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN proofs f USING (tree, node))
SELECT *, folded_root = root AS verified FROM folded
"""
