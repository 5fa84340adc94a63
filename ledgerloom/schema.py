"""Types, vocabularies and constants of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

BASE_AMOUNT = T.DecimalType(18, 4)
RATE = T.DecimalType(20, 10)
CONFIDENCE = T.DecimalType(3, 2)

# Closed vocabularies.
ACCOUNT_NATURES = ("asset", "liability", "equity")
ACCOUNT_TYPES = ("checking", "savings", "credit_card", "cash", "investment", "loan", "mortgage")
CATEGORY_KINDS = ("expense", "income", "transfer", "investment")
RECORD_STATUSES = ("imported", "pending", "posted", "duplicate")
PERIODS = ("day", "week", "month")
PROVIDERS = ("enable_banking", "amex_pdf", "rabobank_pdf", "revolut_pdf", "manual")

# Thresholds and windows.
SYSTEM_EXPENSE = "system_expense"
TIER2_AUTO, TIER2_REVIEW = "0.85", "0.50"
TIER2_TOLERANCE = 1
TIER2_DAYS = (-1, 3)
TRANSFER_TOLERANCE, TRANSFER_TOLERANCE_CROSS = 1, 50
TRANSFER_DAYS = (-1, 3)
TRANSFER_AUTO = "0.90"
SWEEP_DAYS = 90
CARD_PAYMENT_DAYS = (0, 3)
FUZZY_THRESHOLD = 0.6
AUTO_APPLY = "0.90"
RULE_PRIORITY_HAND, RULE_PRIORITY_LEARNED = 100, 500
BALANCE_TOLERANCE = "0.005"
MAX_RANGE_DAYS, DEFAULT_RANGE_DAYS = 3660, 30

ACCOUNT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("account_type", T.StringType()),
    T.StructField("account_nature", T.StringType()), T.StructField("currency", T.StringType()), T.StructField("is_active", T.BooleanType()),
    T.StructField("is_hidden", T.BooleanType()), T.StructField("system_role", T.StringType()), T.StructField("payment_from_account_id", T.LongType()),
])
CATEGORY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
])
JOURNAL_ENTRY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("entry_date", T.DateType()), T.StructField("description", T.StringType()), T.StructField("is_transfer", T.BooleanType()),
])
JOURNAL_LINE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("journal_entry_id", T.LongType()), T.StructField("account_id", T.LongType()),
    T.StructField("amount", T.LongType()), T.StructField("currency", T.StringType()), T.StructField("amount_base", BASE_AMOUNT),
    T.StructField("category_id", T.LongType()), T.StructField("sort_order", T.IntegerType()),
])
#: What a source gives: a normalised row of a statement.
RECORD = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("description", T.StringType()), T.StructField("amount_minor", T.LongType()),
    T.StructField("currency", T.StringType()), T.StructField("booked_date", T.DateType()), T.StructField("value_date", T.DateType()),
    T.StructField("provider_txn_id", T.StringType()), T.StructField("pending", T.BooleanType()), T.StructField("line_number", T.IntegerType()),
])
