"""Statements against ledger rows: identities, chains and running balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity_gaps(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """account_id, period, gap, debits, credits: opening plus movements less closing (a liability prints its balance with the
    other sign, so movements count against it)."""
    sums = rows.groupBy("account_id", "period").agg(
        F.sum("amount").alias("moved"), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(F.lit(0))).alias("debits"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(0))).alias("credits"),
    )
    sign = F.when(F.col("nature") == "liability", F.lit(-1)).otherwise(F.lit(1))
    zero = F.lit(0)
    return statements.join(sums, ["account_id", "period"], "left").select(
        "account_id", "period", (F.col("opening") + sign * F.coalesce("moved", zero) - F.col("closing")).cast("long").alias("gap"),
        F.coalesce("debits", zero).cast("long").alias("debits"), F.coalesce("credits", zero).cast("long").alias("credits"),
    )


def chain_breaks(statements: DataFrame) -> DataFrame:
    """account_id, period, closing, next_opening where a statement doesn't open as the one before closed."""
    following = F.lead("opening").over(Window.partitionBy("account_id").orderBy("period"))
    return statements.withColumn("next_opening", following).where("next_opening <> closing").select("account_id", "period", "closing", "next_opening")


def monthly(rows: DataFrame) -> DataFrame:
    """Statements that rows (account_id, date, amount) imply: account_id, period, opening, closing per month with rows.

    Months are summed first, so the running total has a row per account and month."""
    by_month = rows.groupBy("account_id", F.date_format("date", "yyyy-MM").alias("period")).agg(F.sum("amount").alias("moved"))
    closing = F.sum("moved").over(Window.partitionBy("account_id").orderBy("period"))
    return by_month.select("account_id", "period", (closing - F.col("moved")).cast("long").alias("opening"), closing.cast("long").alias("closing"))


#: Line numbers that share a block of running_balance().
BALANCE_BLOCK = 65_536


def running_balance(rows: DataFrame) -> DataFrame:
    """rows (account_id, line_number, amount) with balance after each, in line order; lines without a number come first.

    Within an account, lines are totalled by blocks of BALANCE_BLOCK numbers and each block starts from the sum of those before
    it, so an account of any number of lines is dealt over many tasks; what is windowed by account has a row for each block."""
    block = F.floor(F.col("line_number") / BALANCE_BLOCK)
    in_block = Window.partitionBy("account_id", "_block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_block", F.coalesce(block, F.lit(-(1 << 62))))
    before = Window.partitionBy("_account").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy(F.col("account_id").alias("_account"), F.col("_block").alias("_at")).agg(F.sum("amount").alias("_sum"))
    starts = sums.select("_account", "_at", F.sum("_sum").over(before).alias("_before"))
    totalled = numbered.withColumn("_in_block", F.sum("amount").over(in_block))
    joined = totalled.join(starts, F.col("account_id").eqNullSafe(F.col("_account")) & (F.col("_block") == F.col("_at")))
    # Null only while no line before had an amount.
    start, within = F.col("_before"), F.col("_in_block")
    balance = F.when(start.isNull(), within).otherwise(start + F.coalesce(within, F.lit(0))).cast("long")
    return joined.select(*rows.columns, balance.alias("balance"))


def balance_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose printed balance is not what opening and movements give."""
    return running_balance(rows).where(~F.col("printed").eqNullSafe(F.col("opening") + F.col("balance")))


def batch_status(records: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """batch_id, record_count, created, duplicated, failed, status; with `unread` (a row for each that a source couldn't read:
    batch_id) also parse_failed. Rows that weren't read are no records: they don't make a batch partial, but a batch of nothing
    else failed."""
    columns = ["batch_id", "outcome"]
    rows = records.select(*columns, F.lit(True).alias("read"))
    if unread is not None:
        rows = rows.unionByName(unread.select("batch_id", F.lit(None).cast("string").alias("outcome"), F.lit(False).alias("read")))
    count = lambda o: F.count_if(F.col("read") & (F.col("outcome") == o)).alias(o)
    counts = rows.groupBy("batch_id").agg(F.count_if("read").alias("record_count"), count("created"), count("duplicated"), count("failed"), *([F.count_if(~F.col("read")).alias("parse_failed")] if unread is not None else []))
    status = F.when(F.col("record_count") == 0, "failed").when(F.col("created") + F.col("duplicated") == F.col("record_count"), "completed").otherwise("partial")
    return counts.withColumn("status", status)
