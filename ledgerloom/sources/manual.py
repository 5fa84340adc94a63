"""Rows typed by hand, and the raw fields that every row keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_entries(rows: DataFrame) -> DataFrame:
    """Rows (account_id, description, amount_minor, currency, booked_date, line_number) with error: a trimmed description of 1 to
    500 characters and a date are asked for; a date is never made up."""
    text = F.trim("description")
    error = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("no description")).when(F.length(text) > 500, F.lit("description too long")).when(F.col("booked_date").isNull(), F.lit("no date"))
    return rows.withColumn("description", text).withColumn("error", error)


def with_defaults(raw: Column, description: Column, amount: Column, currency: Column) -> Column:
    """raw (map of strings) with description, amount and currency where it lacks them."""
    defaults = F.create_map(F.lit("description"), description, F.lit("amount_minor"), amount.cast("string"), F.lit("currency"), currency)
    missing = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(raw), k), F.lit(False)))
    return F.map_concat(missing, F.coalesce(raw, F.create_map().cast("map<string,string>")))
