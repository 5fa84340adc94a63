"""Integrity rules as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACCOUNT_NATURES, ACCOUNT_TYPES, CATEGORY_KINDS, PROVIDERS, RECORD_STATUSES


def duplicates(df: DataFrame, *key: str, where: str | None = None, nulls_equal: bool = True, times: str | None = None) -> DataFrame:
    """Key values that occur more than once, with their count. Null keys count as equal, or never collide.

    times: a column that says how many rows a row stands for."""
    rows = df if where is None else df.where(where)
    if not nulls_equal:
        rows = rows.dropna(subset=list(key))
    return rows.groupBy(*key).agg((F.count("*") if times is None else F.sum(times)).alias("n")).where("n > 1")


def bad_decimals(currencies: DataFrame) -> DataFrame:
    return currencies.where(~F.coalesce(F.col("decimals").between(0, 18), F.lit(False)))


def bad_rates(rates: DataFrame) -> DataFrame:
    return rates.where(~F.coalesce(F.col("rate") > 0, F.lit(False)))


def changed_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change of raw rows that were deleted, or whose raw fields were altered."""
    n = new.select("id", F.col("raw_description").alias("_d"), F.col("raw_data").alias("_r"), F.lit(True).alias("_there"))
    joined = old.join(n, "id", "left")
    same = F.col("raw_description").eqNullSafe(F.col("_d")) & F.col("raw_data").eqNullSafe(F.col("_r"))
    change = F.when(F.col("_there").isNull(), F.lit("deleted")).when(~same, F.lit("altered"))
    return joined.select("id", change.alias("change")).where("change is not null")


def half_synthesised(lines: DataFrame) -> DataFrame:
    """Lines whose flag and reason disagree."""
    return lines.where(F.col("is_synthesized") != F.col("synthesized_reason").isNotNull())


def self_matched(matches: DataFrame) -> DataFrame:
    return matches.where("out_id = in_id")


def self_paying(accounts: DataFrame) -> DataFrame:
    return accounts.where("payment_from_account_id = id")


def outside_vocabulary(accounts: DataFrame, categories: DataFrame, rows: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """what, id, value of fields outside their closed lists; of rows (status) and batches (provider) too, if given."""
    def outside(df: DataFrame, what: str, allowed) -> DataFrame:
        as_text = F.col("id") if rows is None and batches is None else F.col("id").cast("string").alias("id")
        return df.where(~F.coalesce(F.col(what).isin(*allowed), F.lit(False))).select(F.lit(what).alias("what"), as_text, F.col(what).alias("value"))

    found = outside(accounts, "account_type", ACCOUNT_TYPES).union(outside(accounts, "account_nature", ACCOUNT_NATURES)).union(outside(categories, "kind", CATEGORY_KINDS))
    if rows is not None:
        found = found.union(outside(rows, "status", RECORD_STATUSES))
    return found if batches is None else found.union(outside(batches, "provider", PROVIDERS))


def touched(old: DataFrame, new: DataFrame, *fields: str) -> DataFrame:
    """new with updated_at: now for rows that differ from old in a field, the old time for others."""
    o = old.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.col("updated_at").alias("_at"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return new.drop("updated_at").join(o, "id", "left").withColumn("updated_at", F.when(same & F.col("_at").isNotNull(), F.col("_at")).otherwise(F.current_timestamp())).select(*new.drop("updated_at").columns, "updated_at")
