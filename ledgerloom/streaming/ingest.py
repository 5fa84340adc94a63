"""Records that arrive as a stream of files. An extension: the batch import is the reference for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..schema import RECORD, TIER2_DAYS, TIER2_TOLERANCE


def stream_of_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RECORD).parquet(path).withColumn("event_time", F.col("booked_date").cast("timestamp"))


def new_records(records: DataFrame, delay: str = "10 days") -> DataFrame:
    """Each fingerprint once within the delay. Occurrence ranks need all rows of a file, so rows carry theirs as line_number."""
    key = fingerprint(F.col("description"), F.col("amount_minor"), F.col("currency"), F.col("booked_date"), F.col("account_id"), F.col("line_number"))
    return records.withColumn("fingerprint", key).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def pending_matches(pending: DataFrame, booked: DataFrame, delay: str = "10 days") -> DataFrame:
    """Pairs of pending and booked rows of one account, amounts within the tolerance, in the window of days."""
    lo, hi = TIER2_DAYS
    p = pending.withWatermark("event_time", delay).select(F.col("account_id").alias("p_account"), F.col("amount_minor").alias("p_amount"), F.col("event_time").alias("p_time"), F.col("description").alias("p_description"))
    b = booked.withWatermark("event_time", delay).select(F.col("account_id").alias("b_account"), F.col("amount_minor").alias("b_amount"), F.col("event_time").alias("b_time"), F.col("description").alias("b_description"))
    near = F.expr(f"p_account = b_account AND p_amount BETWEEN b_amount - {TIER2_TOLERANCE} AND b_amount + {TIER2_TOLERANCE} AND p_time BETWEEN b_time + INTERVAL {lo} DAYS AND b_time + INTERVAL {hi} DAYS")
    return p.join(b, near)
