"""Seven layers that find a category for a description, and rules learned from corrections.

Rules, aliases and merchants are what a user keeps by hand. Up to `MOST_RULES` they become one row of sorted arrays,
which is broadcast. If any of the three is longer, each distinct description is joined with what it may contain (by
the first characters of the pattern) or be like (by shared trigrams); both ways give the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, payee_stem, plainly_normalised, word_similarity
from ..schema import AUTO_APPLY, CONFIDENCE, FUZZY_THRESHOLD, RULE_PRIORITY_HAND, RULE_PRIORITY_LEARNED

#: Rows of rules, aliases or merchants that go to every executor.
MOST_RULES = 20_000


def _one_row(df: DataFrame, name: str) -> DataFrame:
    """All rows of a small table as one array of structs sorted by its columns in order."""
    return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))


def _found(category: Column, confidence: Column, layer: int) -> Column:
    return F.struct(category.alias("category_id"), confidence.cast(CONFIDENCE).alias("confidence"), F.lit(layer).alias("layer"))


def categorize(rows: DataFrame, rules: DataFrame, aliases: DataFrame, merchants: DataFrame, description: str = "description", most: int = MOST_RULES) -> DataFrame:
    """rows with category_id, confidence, layer: 1 rules (priority, pattern), 2 aliases, 3 merchants named in the text, 4 merchants like it, 7 none."""
    rules = rules.where("trim(description_pattern) <> ''").select("priority", F.lower(F.trim("description_pattern")).alias("pattern"), "category_id")
    aliases = aliases.where("category_id is not null").select(F.lower("raw_string").alias("pattern"), "category_id", F.col("confidence").cast(CONFIDENCE).alias("confidence"))
    merchants = merchants.where("category_id is not null").select(F.lower("name").alias("pattern"), "category_id")
    text = rows.withColumn("_text", plainly_normalised(F.coalesce(description, F.lit(""))))
    small = all(df.limit(most + 1).count() <= most for df in (rules, aliases, merchants))
    layers = _broadcast_layers(text, rules, aliases, merchants) if small else _joined_layers(text, rules, aliases, merchants)
    return layers.select(*rows.columns, "_found.*")


def _broadcast_layers(text: DataFrame, rules: DataFrame, aliases: DataFrame, merchants: DataFrame) -> DataFrame:
    small = _one_row(rules, "_rules").crossJoin(_one_row(aliases, "_aliases")).crossJoin(_one_row(merchants, "_merchants"))
    text = text.crossJoin(F.broadcast(small))

    def first_contained(name: str) -> Column:
        return F.get(F.filter(name, lambda x: F.contains("_text", x["pattern"])), F.lit(0))

    scored = F.filter(F.transform("_merchants", lambda m: F.struct((-word_similarity(m["pattern"], F.col("_text"))).alias("score"), m["pattern"].alias("pattern"), m["category_id"].alias("category_id"))), lambda s: s["score"] <= -FUZZY_THRESHOLD)
    return text.withColumn("_found", _layers(first_contained("_rules"), first_contained("_aliases"), first_contained("_merchants"), F.get(F.sort_array(scored), F.lit(0))))


def _layers(rule: Column, alias: Column, named: Column, like: Column) -> Column:
    return F.coalesce(
        F.when(rule.isNotNull(), _found(rule["category_id"], F.expr("1.00BD"), 1)), F.when(alias.isNotNull(), _found(alias["category_id"], alias["confidence"], 2)),
        F.when(named.isNotNull(), _found(named["category_id"], F.expr("0.90BD"), 3)), F.when(like.isNotNull(), _found(like["category_id"], F.expr("0.60BD"), 4)),
        _found(F.lit(None).cast("long"), F.expr("0.00BD"), 7),
    )


#: Characters of a pattern that it is joined by.
_KEY = 3


def _joined_layers(text: DataFrame, rules: DataFrame, aliases: DataFrame, merchants: DataFrame) -> DataFrame:
    distinct = text.select("_text").distinct()
    # Every string of up to _KEY characters of a text, the empty one among them: what a pattern in it may begin with.
    places = F.sequence(F.lit(1), F.length("_text") + 1)
    keys = distinct.select("_text", F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.lit(_KEY)), lambda n: F.substring("_text", i, n)))))).alias("_key"))

    def first_contained(patterns: DataFrame, name: str) -> DataFrame:
        keyed = patterns.withColumn("_key", F.substring("pattern", 1, _KEY))
        hits = keys.join(keyed, "_key").where(F.contains("_text", "pattern"))
        return hits.groupBy("_text").agg(F.min(F.struct(*patterns.columns)).alias(name))

    pairs = fuzzy_candidates(distinct.withColumnRenamed("_text", "description"), merchants.select(F.col("pattern").alias("name")))
    scored = pairs.withColumn("score", -word_similarity(F.col("name"), F.col("description"))).where(F.col("score") <= -FUZZY_THRESHOLD)
    like = scored.join(merchants.withColumnRenamed("pattern", "name"), "name").groupBy(F.col("description").alias("_text")).agg(F.min(F.struct("score", "name", "category_id")).alias("_like"))
    all_ = distinct.join(first_contained(rules, "_rule"), "_text", "left").join(first_contained(aliases, "_alias"), "_text", "left").join(first_contained(merchants, "_named"), "_text", "left").join(like, "_text", "left")
    return text.join(all_.select("_text", _layers(*[F.col(c) for c in ("_rule", "_alias", "_named", "_like")]).alias("_found")), "_text")


def applied(categorised: DataFrame) -> DataFrame:
    """The category is written only from the bar of confidence on."""
    return categorised.withColumn("applied_category_id", F.when(F.col("confidence") >= F.expr(f"{AUTO_APPLY}BD"), F.col("category_id")))


def fuzzy_candidates(descriptions: DataFrame, merchants: DataFrame) -> DataFrame:
    """description, name of pairs that share a trigram; others have similarity 0. For merchant lists of any size."""
    left = descriptions.select("description").distinct().select("description", F.explode(grams(plainly_normalised(F.col("description")))).alias("gram"))
    right = merchants.select("name").distinct().select("name", F.explode(grams(F.col("name"))).alias("gram"))
    return left.join(right, "gram").select("description", "name").distinct()


def best_merchant(descriptions: DataFrame, merchants: DataFrame) -> DataFrame:
    """description, name, score: the most similar merchant from the threshold on; ties by name."""
    scored = fuzzy_candidates(descriptions, merchants).withColumn("score", word_similarity(F.col("name"), F.col("description"))).where(F.col("score") >= FUZZY_THRESHOLD)
    best = scored.groupBy("description").agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("m"))
    return best.select("description", F.col("m.name").alias("name"), (-F.col("m.minus")).alias("score"))


def learn(rules: DataFrame, corrections: DataFrame) -> DataFrame:
    """rules with one learned rule per payee stem of the corrections (description, category_id, id); the latest correction of
    a stem wins, learned rules of that stem are replaced, rules made by hand stay."""
    latest = corrections.select(payee_stem(F.col("description")).alias("description_pattern"), "category_id", "id").where("description_pattern <> ''").groupBy("description_pattern").agg(F.max_by("category_id", "id").alias("category_id"))
    fresh = latest.select(F.lit(RULE_PRIORITY_LEARNED).alias("priority"), "description_pattern", "category_id", F.lit(True).alias("is_learned"))
    replaced = fresh.select("description_pattern", "is_learned")
    return rules.join(replaced, ["description_pattern", "is_learned"], "left_anti").select("priority", "description_pattern", "category_id", "is_learned").unionByName(fresh)


def hand_rules(spark, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(RULE_PRIORITY_HAND, p, c, False) for p, c in rows], "priority int, description_pattern string, category_id long, is_learned boolean")
