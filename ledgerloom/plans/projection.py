"""The driver's tables seen as a ledger."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import base_from_minor, minor_from_number
from ..schema import SYSTEM_EXPENSE

SUPPLIER_BASE, EXPENSE_ACCOUNT = 1_000_000, 9_000_000
SUFFIXES = ("", " *", " *REF:000123", " #REF 000123", " CARD:9876", "  ")


@dataclass(frozen=True)
class Ledger:
    """Lazy views over the tables of a folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def accounts(self) -> DataFrame:
        """Customers are checking accounts, suppliers credit cards, and one equity account takes the other side."""
        null = F.lit(None).cast("string")
        cust = self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("checking").alias("account_type"), F.lit("asset").alias("account_nature"),
            F.when(F.col("c_custkey") % 20 == 0, F.lit("USD")).otherwise(F.lit("EUR")).alias("currency"), (F.col("c_custkey") % 11 != 0).alias("is_active"),
            null.alias("system_role"), F.lit(None).cast("long").alias("payment_from_account_id"),
        )
        supp = self.table("supplier").select(
            (F.lit(SUPPLIER_BASE) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("credit_card").alias("account_type"), F.lit("liability").alias("account_nature"),
            F.lit("EUR").alias("currency"), F.lit(True).alias("is_active"), null.alias("system_role"), (F.col("s_suppkey") - F.col("s_suppkey") % 2).alias("payment_from_account_id"),
        )
        system = self.spark.range(1).select(
            F.lit(EXPENSE_ACCOUNT).cast("long").alias("id"), F.lit("System expense").alias("name"), F.lit("cash").alias("account_type"), F.lit("equity").alias("account_nature"),
            F.lit("EUR").alias("currency"), F.lit(True).alias("is_active"), F.lit(SYSTEM_EXPENSE).alias("system_role"), F.lit(None).cast("long").alias("payment_from_account_id"),
        )
        return cust.unionByName(supp).unionByName(system)

    @cached_property
    def categories(self) -> DataFrame:
        regions = self.table("region").select((1 + F.col("r_regionkey")).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit("expense").alias("kind"))
        nations = self.table("nation").select((100 + F.col("n_nationkey")).cast("long").alias("id"), (1 + F.col("n_regionkey")).cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.lit("expense").alias("kind"))
        return regions.unionByName(nations)

    @cached_property
    def entries(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("entry_date"), (F.col("o_orderpriority") == "1-URGENT").alias("is_transfer")
        )

    @cached_property
    def _counts(self) -> dict[str, int]:
        return {}

    def count(self, name: str) -> int:
        """Size of a table that keys wrap around, counted when it is first asked for."""
        if name not in self._counts:
            self._counts[name] = self.table(name).count()
        return self._counts[name]

    @cached_property
    def _orders(self) -> DataFrame:
        nation = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        transfer = F.col("o_orderpriority") == "1-URGENT"
        sign = F.when((F.col("o_orderstatus") == "P") & ~transfer, F.lit(1)).otherwise(F.lit(-1))
        return self.table("orders").join(nation, "o_custkey").select(
            "o_orderkey", "o_custkey", transfer.alias("is_transfer"), (sign * minor_from_number(F.col("o_totalprice"))).cast("long").alias("amount"),
            F.when((F.col("o_orderkey") % 7 != 0) & ~transfer, (100 + F.col("c_nationkey")).cast("long")).alias("category_id"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Two legs per entry. Legs are unpivoted from one scan."""
        other = F.when(~F.col("is_transfer"), F.lit(EXPENSE_ACCOUNT).cast("long")).when(
            F.col("o_orderkey") % 2 == 0, SUPPLIER_BASE + F.col("o_orderkey") % self.count("supplier")
        ).otherwise((F.col("o_custkey") + 1) % self.count("customer"))

        def leg(i: int, account: Column, amount: Column, category: Column) -> Column:
            return F.struct(
                (2 * F.col("o_orderkey") + i).alias("id"), F.col("o_orderkey").alias("journal_entry_id"), account.cast("long").alias("account_id"), amount.alias("amount"),
                F.lit("EUR").alias("currency"), base_from_minor(amount).alias("amount_base"), category.alias("category_id"), F.lit(i).alias("sort_order"),
            )

        legs = F.array(leg(0, F.col("o_custkey"), F.col("amount"), F.col("category_id")), leg(1, other, -F.col("amount"), F.lit(None).cast("long")))
        return self._orders.select(F.explode(legs).alias("leg")).select("leg.*")

    @cached_property
    def records(self) -> DataFrame:
        """One raw row per order; coarse keys so that rows do coincide."""
        key = F.col("o_orderkey")
        part = self.table("part").select("p_partkey", "p_name")
        suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (key % 6 + 1).cast("int"))
        return self.table("orders").withColumn("p_partkey", key % self.count("part")).join(part, "p_partkey").select(
            key.alias("id"), F.concat(F.upper("p_name"), suffix).alias("raw_description"), (F.col("o_custkey") % 50).alias("account_id"),
            (-100 * (1 + key % 3)).cast("long").alias("raw_amount"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("raw_date"), F.lit("EUR").alias("currency"),
            F.year("o_orderdate").cast("long").alias("batch_id"), key.alias("line_number"),
        )

    @cached_property
    def legs(self) -> DataFrame:
        """Events as account movements that may be halves of transfers."""
        out = F.col("event_type").isin("purchase", "error")
        return self.table("events").where(F.col("value").isNotNull()).select(
            F.col("event_id").alias("journal_line_id"), F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("booked_date"),
            (F.when(out, F.lit(-1)).otherwise(F.lit(1)) * minor_from_number(F.col("value"))).cast("long").alias("amount"),
            F.when(F.col("user_id") % 10 == 0, F.lit("USD")).otherwise(F.lit("EUR")).alias("currency"),
        )


# The same views as CTEs of the SQL that queries are checked with.
SQL = f"""
WITH RECURSIVE account AS (
  SELECT CAST(c_custkey AS BIGINT) id, c_name AS name, 'checking' account_type, 'asset' account_nature,
    CASE WHEN c_custkey % 20 = 0 THEN 'USD' ELSE 'EUR' END currency, c_custkey % 11 <> 0 is_active, CAST(NULL AS VARCHAR) system_role, CAST(NULL AS BIGINT) payment_from_account_id FROM customer
  UNION ALL SELECT {SUPPLIER_BASE} + s_suppkey, s_name, 'credit_card', 'liability', 'EUR', TRUE, NULL, s_suppkey - s_suppkey % 2 FROM supplier
  UNION ALL SELECT {EXPENSE_ACCOUNT}, 'System expense', 'cash', 'equity', 'EUR', TRUE, '{SYSTEM_EXPENSE}', NULL
), category AS (
  SELECT CAST(1 + r_regionkey AS BIGINT) id, CAST(NULL AS BIGINT) parent_id, r_name AS name, 'expense' kind FROM region
  UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name, 'expense' FROM nation
), journal_entry AS (
  SELECT o_orderkey id, CAST(o_orderdate AS DATE) entry_date, o_orderpriority = '1-URGENT' is_transfer FROM orders
), ordr AS (
  SELECT o_orderkey, o_custkey, o_orderpriority = '1-URGENT' is_transfer, c_nationkey,
    (CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' THEN 1 ELSE -1 END) * CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * 100) AS BIGINT) amount
  FROM orders JOIN customer ON o_custkey = c_custkey
), journal_line AS (
  SELECT 2 * o_orderkey id, o_orderkey journal_entry_id, o_custkey account_id, amount, 'EUR' currency, CAST(amount * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) amount_base,
    CASE WHEN o_orderkey % 7 <> 0 AND NOT is_transfer THEN CAST(100 + c_nationkey AS BIGINT) END category_id, 0 sort_order FROM ordr
  UNION ALL SELECT 2 * o_orderkey + 1, o_orderkey, CASE WHEN NOT is_transfer THEN {EXPENSE_ACCOUNT} WHEN o_orderkey % 2 = 0 THEN {SUPPLIER_BASE} + o_orderkey % (SELECT count(*) FROM supplier)
    ELSE (o_custkey + 1) % (SELECT count(*) FROM customer) END, -amount, 'EUR', CAST(-amount * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)), NULL, 1 FROM ordr
), source_record AS (
  SELECT o_orderkey id, upper(p_name) || [{', '.join(f"'{s}'" for s in SUFFIXES)}][o_orderkey % 6 + 1] raw_description, o_custkey % 50 account_id, CAST(-100 * (1 + o_orderkey % 3) AS BIGINT) raw_amount,
    CAST(date_trunc('month', o_orderdate) AS DATE) raw_date, 'EUR' currency, CAST(year(o_orderdate) AS BIGINT) batch_id, o_orderkey line_number
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
), leg AS (
  SELECT event_id journal_line_id, user_id account_id, CAST(ts AS DATE) booked_date,
    (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END) * CAST(round(CAST(value AS DECIMAL(18,4)) * 100) AS BIGINT) amount,
    CASE WHEN user_id % 10 = 0 THEN 'USD' ELSE 'EUR' END currency FROM events WHERE value IS NOT NULL
)
"""
