"""Posting of card payments: attach to the half that the other statement left, rewrite its expense, build anew, or refuse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_span, spans_between
from ..schema import BASE_AMOUNT, CARD_PAYMENT_DAYS
from .posting import card_payment_roles

POSTED = "id long, shape string, reason string, line_id long, entry_id long"
AMBIGUOUS = "more than one counterpart"


def with_roles(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """rows (id, account_id, amount, currency, date) with card_id, paying_id and a refusal: the two accounts must be known,
    active, and in the row's currency. An `explicit_id` column names the other account where the row's own tells none.

    Accounts are looked up for each pair of accounts that rows name, not for each row: rows name few, and most have no card, so
    that rows joined by those would meet in a few tasks."""
    roles = card_payment_roles(accounts)
    a = accounts.select("id", "account_nature", "currency", "is_active")
    own, other = a.select(*[F.col(c).alias(f"own_{c}") for c in a.columns]), a.select(*[F.col(c).alias(f"other_{c}") for c in a.columns])
    if "explicit_id" not in rows.columns:
        rows = rows.withColumn("explicit_id", F.lit(None).cast("long"))
    asked = rows.select("account_id", "explicit_id").distinct()
    joined = asked.join(roles, "account_id", "left").join(own, F.col("account_id") == F.col("own_id"), "left").join(other, F.col("explicit_id") == F.col("other_id"), "left")
    # An explicit counterpart: the liability of the two is the card, the asset pays.
    stated = F.col("explicit_id").isNotNull()
    own_card = (F.col("own_account_nature") == "liability") & (F.col("other_account_nature") == "asset")
    own_pays = (F.col("own_account_nature") == "asset") & (F.col("other_account_nature") == "liability")
    card = F.when(stated, F.when(own_card, F.col("account_id")).when(own_pays, F.col("explicit_id"))).otherwise(F.col("card_id"))
    paying = F.when(stated, F.when(own_card, F.col("explicit_id")).when(own_pays, F.col("account_id"))).otherwise(F.col("paying_id"))
    named = joined.select(*asked.columns, card.alias("card_id"), paying.alias("paying_id"))
    for side in ("card", "paying"):
        named = named.join(a.select(*[F.col(c).alias(f"{side}_{c}") for c in a.columns if c != "id"], F.col("id").alias(f"_{side}")), F.col(f"{side}_id") == F.col(f"_{side}"), "left")
    named = named.select(F.col("account_id").alias("_own"), F.col("explicit_id").alias("_other"), "card_id", "paying_id", "card_is_active", "paying_is_active", "card_currency", "paying_currency")
    named = rows.join(named, F.col("account_id").eqNullSafe(F.col("_own")) & F.col("explicit_id").eqNullSafe(F.col("_other")), "left")
    active = F.coalesce(F.col("card_is_active") & F.col("paying_is_active"), F.lit(False))
    reason = F.when(~active, "no card and paying account").when(F.col("card_id") == F.col("paying_id"), "same account").when(
        (F.col("card_currency") != F.col("currency")) | (F.col("paying_currency") != F.col("currency")), "currency of an account differs"
    ).when(F.col("amount") == 0, "zero amount")
    return named.select(*rows.columns, "card_id", "paying_id", reason.alias("refusal"))


def _counterparts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """id, step, line_id, entry_id: lines that may be a row's other half. Step 1: a half on the row's own account that the
    other statement's import made up; step 2, for rows of the card: an expense posted on the paying account.

    lines: id, entry_id, account_id, amount, date, is_synthesized, is_matched, is_expense."""
    lo, hi = CARD_PAYMENT_DAYS
    on_card = F.col("account_id") == F.col("card_id")
    credit = F.abs("amount")
    # One row for each place to look at: the account, the exact amount, and the first and last date.
    first = F.when(on_card, F.date_add("date", lo)).otherwise(F.date_add("date", -hi))
    last = F.when(on_card, F.date_add("date", hi)).otherwise(F.date_add("date", -lo))
    places = rows.select("id", F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.col("account_id").alias("at"), F.when(on_card, credit).otherwise(-credit).alias("want"), first.alias("first"), last.alias("last")),
        F.struct(F.lit(2).alias("step"), F.when(on_card, F.col("paying_id")).alias("at"), (-credit).alias("want"), first.alias("first"), last.alias("last")),
    )).alias("p")).select("id", "p.*")
    places = places.withColumn("span", F.explode(spans_between(F.col("first"), F.col("last"), CARD_PAYMENT_DAYS)))
    step = F.when(F.col("is_synthesized"), 1).when(F.col("is_expense"), 2)
    halves = lines.where("not is_matched").select(step.alias("step"), F.col("account_id").alias("at"), F.col("amount").alias("want"), days_span(F.col("date"), CARD_PAYMENT_DAYS).alias("span"), "date", F.col("id").alias("line_id"), "entry_id").where("step is not null")
    return places.join(halves, ["step", "at", "want", "span"]).where(F.col("date").between(F.col("first"), F.col("last"))).select("id", "step", "line_id", "entry_id")


def _in_turn(group: pd.DataFrame) -> pd.DataFrame:
    """Rows in order; a line that a row took is gone for later ones."""
    used, out = set(), []
    for row_id, found in group.sort_values(["line_number", "id", "step", "line_id"]).groupby(["line_number", "id"], sort=True):
        decision = ("build", None, None, None)
        for step, shape in ((1, "match"), (2, "rewrite")):
            free = found[(found["step"] == step) & ~found["line_id"].isin(used)]
            if len(free) > 1:
                decision = ("refused", AMBIGUOUS, None, None)
            elif len(free) == 1:
                used.add(free["line_id"].iloc[0])
                decision = (shape, None, int(free["line_id"].iloc[0]), int(free["entry_id"].iloc[0]))
            if len(free):
                break
        out.append((int(row_id[1]), *decision))
    return pd.DataFrame(out, columns=["id", "shape", "reason", "line_id", "entry_id"])


def post_card_payments(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """id, shape (match, rewrite, build or refused), reason, line_id and entry_id of rows that with_roles() gave.

    Rows that share no counterpart with another row are decided by counts alone. The others are taken in the order of their
    lines, by the paying account and the amount: only those can meet."""
    good = rows.where("refusal is null")
    # Read four times; checkpoint() keeps it in the folder that the cluster shares.
    found = _counterparts(good, lines).checkpoint()
    contested = found.join(found.groupBy("line_id").agg(F.countDistinct("id").alias("n")).where("n > 1"), "line_id", "left_semi").select("id").distinct()
    per_step = found.groupBy("id", "step").agg(F.count("*").alias("n"), F.min("line_id").alias("line_id"), F.min("entry_id").alias("entry_id"))
    first = per_step.groupBy("id").agg(F.min(F.struct("step", "n", "line_id", "entry_id")).alias("f"))
    shape = F.when(F.col("f").isNull(), "build").when(F.col("f.n") > 1, "refused").when(F.col("f.step") == 1, "match").otherwise("rewrite")
    alone = good.select("id").join(contested, "id", "left_anti").join(first, "id", "left").withColumn("shape", shape)
    taken = F.col("shape").isin("match", "rewrite")
    decided = alone.select("id", "shape", F.when(F.col("shape") == "refused", AMBIGUOUS).alias("reason"), F.when(taken, F.col("f.line_id")).alias("line_id"), F.when(taken, F.col("f.entry_id")).alias("entry_id"))
    meeting = good.join(contested, "id", "left_semi").select("id", "line_number", "paying_id", F.abs("amount").alias("credit")).join(found, "id")
    in_turn = meeting.groupBy("paying_id", "credit").applyInPandas(_in_turn, POSTED)
    refused = rows.where("refusal is not null").select("id", F.lit("refused").alias("shape"), F.col("refusal").alias("reason"), F.lit(None).cast("long").alias("line_id"), F.lit(None).cast("long").alias("entry_id"))
    return decided.unionByName(in_turn).unionByName(refused)


def built_legs(amount: Column) -> Column:
    """The two legs of a row whose payment is built: the card's first. The side that no statement printed is marked as made up."""
    credit = F.abs(amount)

    def leg(order: int, account: str, sign: int):
        return F.struct(
            F.lit(order).alias("sort_order"), F.col(account).alias("account_id"), (sign * credit).alias("amount"), F.col("currency").alias("currency"),
            (sign * F.abs("amount_base")).cast(BASE_AMOUNT).alias("amount_base"), (F.col(account) != F.col("account_id")).alias("is_synthesized"),
        )

    return F.array(leg(0, "card_id", 1), leg(1, "paying_id", -1))


def built_entries(new: DataFrame) -> DataFrame:
    """The legs of each payment that is built, keyed by the row's id. new: rows whose shape is build, with amount_base, of the
    credit."""
    return new.select(F.col("id").alias("entry_id"), F.explode(built_legs(F.col("amount"))).alias("leg")).select("entry_id", "leg.*")


def rewritten_lines(lines: DataFrame, rows: DataFrame, posted: DataFrame) -> DataFrame:
    """lines after rewrites: of each rewritten entry the paying line stays, and every other line is replaced by one of the
    card's account. Lines of other entries are as they were."""
    moved = posted.where("shape = 'rewrite'").select("id", F.col("line_id").alias("paying_line"), F.col("entry_id").alias("rewritten"))
    card = moved.join(rows.select("id", "card_id"), "id").select("rewritten", "paying_line", F.col("card_id").alias("_card"))
    joined = lines.join(card, F.col("entry_id") == F.col("rewritten"), "left")
    kept = joined.where("rewritten is null or id = paying_line").select(lines.columns)
    paying = joined.where("id = paying_line")
    opposite = {"account_id": F.col("_card"), "amount": -F.col("amount"), "amount_base": -F.col("amount_base"), "id": -F.col("id"), "is_expense": F.lit(False)}
    new = paying.select(*[opposite.get(c, F.col(c)).cast(lines.schema[c].dataType).alias(c) for c in lines.columns])
    return kept.unionByName(new)


def card_links(touched: DataFrame, lines: DataFrame) -> DataFrame:
    """The links (out_id, in_id, method, confidence) of entries that card payments attached to or rewrote: from the paying line
    to the card's. lines: as they are after rewrites; entries of other than one line a side give none."""
    entries = touched.select("entry_id").distinct()
    out, in_ = F.col("amount") < 0, F.col("amount") > 0
    sides = lines.join(entries, "entry_id", "left_semi").groupBy("entry_id").agg(
        F.count_if(out).alias("n_out"), F.count_if(in_).alias("n_in"), F.min(F.when(out, F.col("id"))).alias("out_id"), F.min(F.when(in_, F.col("id"))).alias("in_id")
    )
    return sides.where("n_out = 1 and n_in = 1").select("out_id", "in_id", F.lit("auto_card_payment").alias("method"), F.expr("0.95BD").cast("decimal(3,2)").alias("confidence"))
