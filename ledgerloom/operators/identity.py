"""Which rows are known already: occurrence ranks, fingerprints and the three tiers of matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_span, spans_between
from ..functions.text import dice, fingerprint, normalised
from ..schema import CONFIDENCE, TIER2_AUTO, TIER2_DAYS, TIER2_REVIEW, TIER2_TOLERANCE


def occurrence_index(records: DataFrame, description="raw_description", amount="raw_amount", date="raw_date", currency="currency", account="account_id", order=("line_number", "id")) -> DataFrame:
    """records with occurrence_index: the rank, from 1, among rows of equal content."""
    key = [F.col(account), normalised(F.col(description)), F.col(amount), F.col(currency), F.col(date)]
    return records.withColumn("occurrence_index", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def with_fingerprint(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("raw_description", "raw_amount", "currency", "raw_date", "account_id", "occurrence_index")]))


def known_by_provider_id(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Tier 1: rows whose provider id the account has; empty ids match nothing."""
    ids = stored.where("provider_txn_id <> ''").select("account_id", "provider_txn_id").distinct()
    return new.where("provider_txn_id <> ''").join(ids, ["account_id", "provider_txn_id"], "left_semi")


def tier2_candidates(new: DataFrame, stored: DataFrame, same_currency: bool = False) -> DataFrame:
    """new_id, stored_id: one account, amounts within a minor unit, the stored date 1 day before to 3 days after.

    Amounts and spans of days meet by equality: the stored side is repeated for each amount within the tolerance, the new one for
    each span of days that its window touches. So rows of one account and amount meet those of a few days only."""
    lo, hi = TIER2_DAYS
    near = stored.select(
        F.col("id").alias("stored_id"), F.col("account_id").alias("_account"), F.col("booked_date").alias("stored_date"), F.col("currency").alias("_currency"),
        days_span(F.col("booked_date"), TIER2_DAYS).alias("_span"), F.explode(F.array(*[F.col("amount_minor") + d for d in range(-TIER2_TOLERANCE, TIER2_TOLERANCE + 1)])).alias("_amount"),
    )
    first, last = F.date_add("booked_date", lo), F.date_add("booked_date", hi)
    asked = new.select(F.col("id").alias("new_id"), "account_id", "amount_minor", "currency", first.alias("first"), last.alias("last"), F.explode(spans_between(first, last, TIER2_DAYS)).alias("span"))
    on = (F.col("account_id") == F.col("_account")) & (F.col("amount_minor") == F.col("_amount")) & (F.col("span") == F.col("_span")) & F.col("stored_date").between(F.col("first"), F.col("last"))
    if same_currency:
        on = on & (F.col("currency") == F.col("_currency"))
    return asked.join(near, on).select("new_id", "stored_id")


def tier2_score(same_amount: Column, same_date: Column, similarity: Column, same_alias: Column, pending: Column, alternatives: Column) -> Column:
    """1 less a penalty for each weak sign, between 0 and 1; exact decimals."""
    def off(condition: Column, penalty: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.expr(f"{penalty}BD")).otherwise(F.expr("0.00BD"))

    score = F.expr("1.00BD") - off(~same_amount, "0.30") - off(~same_date, "0.20") - off(similarity <= 0.8, "0.20") - off(~F.coalesce(same_alias, F.lit(False)), "0.10") - off(~pending, "0.10") - off(alternatives > 1, "0.10")
    return F.least(F.greatest(score, F.expr("0.00BD")), F.expr("1.00BD")).cast(CONFIDENCE)


def tier2_decisions(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new_id, stored_id, score, decision: the best candidate of each new row (ties: smallest id) and link, review or none."""
    pairs = tier2_candidates(new, stored)
    n, s = new.alias("n"), stored.alias("s")
    joined = pairs.join(n, F.col("new_id") == F.col("n.id")).join(s, F.col("stored_id") == F.col("s.id"))
    score = tier2_score(
        F.col("n.amount_minor") == F.col("s.amount_minor"), F.col("n.booked_date") == F.col("s.booked_date"), dice(normalised(F.col("n.description")), F.col("s.description")),
        F.col("n.merchant_alias_id") == F.col("s.merchant_alias_id"), F.col("s.pending"), F.count("*").over(Window.partitionBy("new_id")),
    )
    best = joined.select("new_id", "stored_id", score.alias("score")).groupBy("new_id").agg(F.max(F.struct(F.col("score"), (-F.col("stored_id")).alias("minus"))).alias("m"))
    decision = F.when(F.col("m.score") >= F.expr(f"{TIER2_AUTO}BD"), "link").when(F.col("m.score") >= F.expr(f"{TIER2_REVIEW}BD"), "review").otherwise("none")
    return best.select("new_id", (-F.col("m.minus")).alias("stored_id"), F.col("m.score").alias("score"), decision.alias("decision"))


def known_by_fingerprint(new: DataFrame, stored: DataFrame, known: bool = True) -> DataFrame:
    """Tier 3: rows whose fingerprint is stored, or those whose isn't."""
    return new.join(stored.select("fingerprint").distinct(), "fingerprint", "left_semi" if known else "left_anti")


def resolve(new: DataFrame, stored: DataFrame) -> DataFrame:
    """id, tier (1, 2, 3 or 0), needs_review, stored_id, score: the first tier that knows the row.

    A row that only its likeness tells (tier 2) waits for a review below the score that decides alone. A stored row is the
    counterpart of one such row at most: of several the one of the best score (ties: smallest id) has it, and the others are
    known by the later tiers or not at all."""
    provider = stored.where("provider_txn_id <> ''").select("account_id", "provider_txn_id", F.lit(True).alias("_1")).distinct()
    prints = stored.select("fingerprint", F.lit(True).alias("_3")).distinct()
    rows = new.select("id", "account_id", "provider_txn_id", "fingerprint").join(provider, ["account_id", "provider_txn_id"], "left").join(prints, "fingerprint", "left")
    liked = tier2_decisions(new, stored).where("decision <> 'none'")
    liked = liked.join(rows.where("_1").select(F.col("id").alias("new_id")), "new_id", "left_anti")
    best = liked.groupBy("stored_id").agg(F.max_by("new_id", F.struct("score", -F.col("new_id"))).alias("new_id"), F.max("score").alias("score"))
    second = best.select(F.col("new_id").alias("id"), "stored_id", "score")
    tier = F.when(F.col("_1"), 1).when(F.col("stored_id").isNotNull(), 2).when(F.col("_3"), 3).otherwise(0)
    review = (tier == 2) & (F.col("score") < F.expr(f"{TIER2_AUTO}BD"))
    return rows.join(second, "id", "left").select("id", tier.alias("tier"), review.alias("needs_review"), "stored_id", "score")


def set_difference(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many fingerprints only one side has, and duplicates among the parsed ones."""
    both = parsed.groupBy("fingerprint").agg(F.count("*").alias("n")).join(stored.select("fingerprint").distinct().withColumn("there", F.lit(1)), "fingerprint", "full_outer")
    return both.agg(F.count_if(F.col("there").isNull()).alias("only_parsed"), F.count_if(F.col("n").isNull()).alias("only_stored"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
