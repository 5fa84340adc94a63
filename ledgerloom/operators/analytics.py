"""Net worth, spending, cash flow, budgets, and what a dashboard derives from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar, period
from ..functions.money import cents, same_currency
from ..schema import DEFAULT_RANGE_DAYS, MAX_RANGE_DAYS, PERIODS


def checked_range(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    if end < start or (end - start).days > MAX_RANGE_DAYS:
        raise ValueError(f"range {start}..{end} is inverted or longer than {MAX_RANGE_DAYS} days")
    return start, end


def default_range(today: dt.date) -> tuple[dt.date, dt.date]:
    """The range of a question that states none."""
    return today - dt.timedelta(DEFAULT_RANGE_DAYS), today


def net_worth_daily(lines: DataFrame, entries: DataFrame, accounts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """date, amount (cents) for each day: all movements of assets and liabilities up to it.

    Summed by day before the running total, which then has a row for each calendar day at most; history before
    the range is one opening row."""
    checked_range(start, end)
    owned = accounts.where(F.col("account_nature").isin("asset", "liability")).select(F.col("id").alias("account_id"))
    dated = entries.where(F.col("entry_date") <= F.lit(end)).select(F.col("id").alias("journal_entry_id"), F.greatest("entry_date", F.lit(start)).alias("date"))
    by_day = lines.join(owned, "account_id").join(dated, "journal_entry_id").groupBy("date").agg(F.sum("amount_base").alias("moved"))
    days = lines.sparkSession.range(1).select(F.explode(calendar(F.lit(start), F.lit(end))).alias("date"))
    running = F.sum(F.coalesce("moved", F.lit(0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(by_day, "date", "left").select("date", cents(running).alias("amount"))


#: Rounds after which the walk is written out, so that its plan doesn't double once more with each.
_ROUNDS_AT_ONCE = 2


def ancestor_paths(categories: DataFrame) -> DataFrame:
    """id, path: each category and its ancestors, nearest first. A walk stops before a node that it has met.

    A round appends to each path that of the node where it ends, so paths double and a tree of any depth takes the
    logarithm of it. Deep trees (over four levels) need a checkpoint folder."""
    walk, rounds = categories.select("id", F.array("id").alias("path"), F.col("parent_id").alias("next")), 0
    while True:
        up = walk.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("next").alias("_next"))
        longer = walk.join(up, walk["next"] == up["_id"], "left").withColumn("all", F.concat("path", F.coalesce("_path", F.array().cast("array<bigint>"))))
        met = F.size(F.array_distinct("all")) < F.size("all")
        walk = longer.select("id", F.array_distinct("all").alias("path"), F.when(~met, F.col("_next")).alias("next"))
        rounds += 1
        if rounds > _ROUNDS_AT_ONCE:
            walk = walk.checkpoint()
        if walk.where("next is not null").isEmpty():
            return walk.select("id", "path")


def category_roots(categories: DataFrame) -> DataFrame:
    """id, root_id: the top ancestor of each category."""
    return ancestor_paths(categories).select("id", F.element_at("path", -1).alias("root_id"))


def spend_by_category(lines: DataFrame, entries: DataFrame, accounts: DataFrame, categories: DataFrame, start: dt.date, end: dt.date, rollup: bool = False) -> DataFrame:
    """category_id, name, kind, amount (cents, negative is spent) over categorised lines; no equity, no transfers."""
    checked_range(start, end)
    plain = entries.where(~F.col("is_transfer") & F.col("entry_date").between(F.lit(start), F.lit(end))).select(F.col("id").alias("journal_entry_id"))
    owned = accounts.where(F.col("account_nature") != "equity").select(F.col("id").alias("account_id"))
    sums = lines.where("category_id is not null").join(plain, "journal_entry_id").join(owned, "account_id").groupBy("category_id").agg(F.sum("amount_base").alias("total"))
    if rollup:
        roots = category_roots(categories).select(F.col("id").alias("category_id"), "root_id")
        sums = sums.join(roots, "category_id").groupBy(F.col("root_id").alias("category_id")).agg(F.sum("total").alias("total"))
    named = categories.select(F.col("id").alias("category_id"), "name", "kind")
    return sums.join(named, "category_id", "left").select(
        "category_id", F.coalesce("name", F.concat(F.lit("Category "), F.col("category_id").cast("string"))).alias("name"), F.coalesce("kind", F.lit("expense")).alias("kind"), cents(F.col("total")).alias("amount")
    ).orderBy("amount", "category_id")


def cashflow(lines: DataFrame, entries: DataFrame, accounts: DataFrame, start: dt.date, end: dt.date, by: str) -> DataFrame:
    """period, income, expense, net (cents) of asset legs; entries of asset legs alone are internal."""
    checked_range(start, end)
    if by not in PERIODS:
        raise ValueError(by)
    dated = entries.where(F.col("entry_date").between(F.lit(start), F.lit(end))).select(F.col("id").alias("journal_entry_id"), "entry_date")
    natures = accounts.select(F.col("id").alias("account_id"), (F.col("account_nature") == "asset").alias("asset"))
    per_entry = lines.join(natures, "account_id").join(dated, "journal_entry_id").groupBy("journal_entry_id", "entry_date").agg(
        F.sum(F.when(F.col("asset"), F.col("amount_base")).otherwise(F.lit(0))).alias("moved"), F.bool_and("asset").alias("internal")
    )
    outside = per_entry.where(~F.col("internal") & (F.col("moved") != 0)).withColumn("period", period(F.col("entry_date"), by))
    zero = F.lit(0).cast("decimal(18,4)")
    return outside.groupBy("period").agg(
        cents(F.sum(F.when(F.col("moved") > 0, F.col("moved")).otherwise(zero))).alias("income"),
        cents(-F.sum(F.when(F.col("moved") < 0, F.col("moved")).otherwise(zero))).alias("expense"), cents(F.sum("moved")).alias("net"),
    ).orderBy("period")


def budget_check(spent: Column, limit: Column, spent_in: Column | None = None, limit_in: Column | None = None) -> tuple[Column, Column, Column]:
    """remaining, over, used percent (half to even; 0 for a limit of 0). The query fails where the two currencies, if given, differ."""
    if spent_in is not None and limit_in is not None:
        spent = same_currency(spent, spent_in, limit_in)
    used = F.when(limit == 0, F.lit(0)).otherwise(F.bround(spent * F.lit(100.0) / limit, 0)).cast("long")
    return limit - spent, spent > limit, used


def period_change(flow: DataFrame) -> DataFrame:
    """Change of expense against the period before, in percent; null without one or if it was 0."""
    before = F.lag("expense").over(Window.orderBy("period"))
    return flow.select("period", "expense", F.round((F.col("expense") - before) * 100.0 / F.nullif(before, F.lit(0)), 4).alias("change_percent"))


def month_gaps(flow: DataFrame, last: dt.date, months: int = 6) -> DataFrame:
    """Those of the months up to that of `last` without a row in flow (period yyyy-MM)."""
    spark = flow.sparkSession
    axis = spark.range(1).select(F.explode(F.sequence(F.add_months(F.trunc(F.lit(last), "month"), 1 - months), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))).alias("month"))
    return axis.select(F.date_format("month", "yyyy-MM").alias("period")).join(flow.select("period"), "period", "left_anti")


def top_expense(spend: DataFrame) -> DataFrame:
    """The category with the most negative amount; of several the one of the smallest id."""
    first = F.min(F.struct("amount", "category_id", "name"))
    return spend.where("kind = 'expense' and amount < 0").agg(first.alias("m")).where("m is not null").select("m.category_id", "m.name", "m.amount")


def share_of_peak(spend: DataFrame) -> DataFrame:
    """Size of each expense against the largest in percent, at least 2."""
    expenses = spend.where("kind = 'expense' and amount < 0")
    peak = expenses.agg(F.greatest(F.max(F.abs("amount")), F.lit(1)).alias("peak"))
    return expenses.crossJoin(F.broadcast(peak)).select("category_id", F.round(F.greatest(F.lit(2.0), F.abs("amount") * 100.0 / F.col("peak")), 6).alias("share"))


def descendants(categories: DataFrame) -> DataFrame:
    """id and n_descendants of every category."""
    below = ancestor_paths(categories).select(F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return categories.select("id").join(below, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"))


def category_forest(categories: DataFrame) -> DataFrame:
    """Every category once, with its depth below its root and why it is detached, if it is:
    not_listed (no such parent), other_kind (the parent is of another kind) or cycle (no root is reached)."""
    listed = categories.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.lit(True).alias("there"))
    own = categories.join(listed, "parent_id", "left")
    reason = F.when(F.col("parent_id").isNull(), F.lit(None)).when(F.col("there").isNull(), F.lit("not_listed")).when(F.col("kind") != F.col("parent_kind"), F.lit("other_kind"))
    own = own.withColumn("reason", reason)
    attached = own.select("id", F.when(F.col("reason").isNull(), F.col("parent_id")).alias("parent_id"))
    tops = attached.where("parent_id is null").select(F.col("id").alias("top"))
    paths = ancestor_paths(attached).select("id", (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("last"))
    found = paths.join(tops, paths["last"] == tops["top"]).select("id", "depth")
    return own.join(found, "id", "left").select("id", "depth", F.when(F.col("depth").isNull(), F.lit("cycle")).otherwise(F.col("reason")).alias("reason"))
