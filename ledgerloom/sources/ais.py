"""Account-information JSON: one payload per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_reference

PAYLOAD = (
    "status string, bookingDate string, valueDate string, transactionAmount struct<amount string, currency string>, "
    "remittanceInformation array<string>, entryReference string, creditor struct<name string>, debtor struct<name string>"
)


def parse_payload(rows: DataFrame) -> DataFrame:
    """Normalised records of rows (account_id, line_number, payload); what can't be read keeps its row and gets an error.

    Booked and pending payloads count, a missing status is booked; others are skipped. Amounts are cut to cents."""
    p = F.from_json("payload", PAYLOAD)
    read = rows.withColumn("p", p).withColumn("status", F.coalesce("p.status", F.lit("BOOK"))).where(F.col("status").isin("BOOK", "PDNG"))
    remittance = F.nullif(F.trim(F.array_join("p.remittanceInformation", " ")), F.lit(""))
    amount = F.col("p.transactionAmount.amount").try_cast("decimal(20,6)")
    booked = parse_date(F.col("p.bookingDate"))
    error = F.when(F.col("p").isNull(), F.lit("unreadable payload")).when(booked.isNull(), F.lit("no booking date")).when(amount.isNull(), F.lit("no amount"))
    return read.select(
        "account_id", F.coalesce(remittance, "p.creditor.name", "p.debtor.name", F.lit("")).alias("description"), (amount * 100).cast("long").alias("amount_minor"),
        F.col("p.transactionAmount.currency").alias("currency"), booked.alias("booked_date"), parse_date(F.col("p.valueDate")).alias("value_date"),
        clean_reference(F.col("p.entryReference")).alias("provider_txn_id"), (F.col("status") == "PDNG").alias("pending"), "line_number", error.alias("error"),
    )


def scalars(payload: Column) -> Column:
    """The scalar fields of a JSON object as a map of texts; nested ones are dropped, null ones stay. Null if it is no object."""
    fields = F.from_json(payload, "map<string,variant>", {"mode": "PERMISSIVE"})
    kept = F.map_filter(fields, lambda _, v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY)"))
    return F.transform_values(kept, lambda _, v: F.try_variant_get(v, "$", "string"))
