"""An import as a whole, and its replay: from records to posted entries, categories, links and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cards, identity, posting, statements, transfers
from ..schema import TRANSFER_DAYS
from .store import Change, LedgerStore, Version

UNATTRIBUTED = "no account, date or amount"


@dataclass(frozen=True)
class Imported:
    """What an import makes of its records. judged has one row per record; everything else is read from it.

    judged: the record's columns with occurrence_index and fingerprint; outcome (created, duplicated, review, failed), shape
    (posted, match, rewrite, build) and reason; tier, stored_id and score of the stored row that it may be; rate, amount_base,
    card_id and paying_id of card payments; contra_id and category of what is posted; line_id and entry_id of the counterpart of a card payment.
    Entries and lines are keyed by the record's id."""

    judged: DataFrame

    @property
    def outcomes(self) -> DataFrame:
        return self.judged.select("id", "batch_id", "line_number", "outcome", "shape", "reason")

    @property
    def rows(self) -> DataFrame:
        """The records to store: posted, or pending with the reason."""
        status = F.when(F.col("outcome") == "created", "posted").otherwise("pending")
        entry = F.when(F.col("outcome") == "created", F.coalesce("entry_id", "id"))
        kept = self.judged.where(F.col("outcome").isin("created", "review") | ((F.col("outcome") == "failed") & (F.col("reason") != UNATTRIBUTED)))
        return kept.select("id", "batch_id", "line_number", "account_id", "raw_description", "raw_amount", "currency", "raw_date", "occurrence_index", "fingerprint", status.alias("status"), F.col("reason").alias("error_message"), entry.alias("entry_id"))

    @property
    def entries(self) -> DataFrame:
        new = self.judged.where("shape in ('posted', 'build')")
        return new.select("id", F.col("raw_date").alias("entry_date"), F.col("raw_description").alias("description"), (F.col("shape") == "build").alias("is_transfer"))

    @property
    def lines(self) -> DataFrame:
        columns = ["entry_id", "sort_order", "account_id", "amount", "currency", "amount_base", "category_id", "is_synthesized"]
        more = {"entry_id": F.col("id"), "is_synthesized": F.lit(False), "category_id": F.lit(None).cast("long")}
        shaped = lambda legs, own: F.transform(legs, lambda leg: F.struct(*[(leg[c] if c in own else more[c]).alias(c) for c in columns]))
        # One pass over the records, whatever their shape.
        legs = F.when(F.col("shape") == "posted", shaped(posting.legs_of(F.col("contra_id"), F.col("filed_under")), [c for c in columns if c != "is_synthesized"]))
        legs = legs.when(F.col("shape") == "build", shaped(cards.built_legs(F.col("raw_amount")), [c for c in columns if c not in ("entry_id", "category_id")]))
        return self.judged.select(F.explode(legs).alias("leg")).select("leg.*")

    @property
    def touched(self) -> DataFrame:
        """The counterparts of card payments."""
        return self.judged.where("line_id is not null").select("id", "line_id", "entry_id", "shape")

    @property
    def reviews(self) -> DataFrame:
        """Rows that may be a stored one: they wait, and are not posted."""
        return self.judged.where("outcome = 'review'").select("id", "stored_id", "score")

    def report(self) -> DataFrame:
        """One row per batch: record_count, created, duplicated, failed, status. Rows that wait are in none of the three."""
        return statements.batch_status(self.judged.select("batch_id", "outcome"))


def import_batch(
    records: DataFrame, stored: DataFrame, accounts: DataFrame, rates: DataFrame, halves: DataFrame, categories: DataFrame | None = None,
    all_tiers: bool = False, currencies: DataFrame | None = None,
) -> Imported:
    """One pass over a batch of records: what is known goes, card payments find their other half, the rest is posted.

    records: id, batch_id, line_number, account_id, raw_description, raw_amount, currency, raw_date, is_card_payment. stored:
    fingerprint (and for `all_tiers` what identity.resolve needs of either side). halves: lines that card payments may
    attach to (see cards). categories: raw_description, category_id to file new expenses under. currencies: code, decimals.

    A record without account, date or amount fails; one whose fingerprint is stored is a duplicate, as is with `all_tiers`
    one that its provider's id or its likeness to a stored row tells (if the likeness isn't sure, the record waits for a
    review); a card payment that is refused, and a row that can't be posted, fail with a reason and are stored pending.

    Records are shuffled by content, for their ranks, and by fingerprint; what else is joined to them are rates and currencies,
    the decisions on card payments, and with `all_tiers` the tiers. Accounts are looked up for card payments only."""
    bad = F.col("account_id").isNull() | F.col("raw_date").isNull() | F.col("raw_amount").isNull()
    rows = identity.with_fingerprint(identity.occurrence_index(records)).withColumn("_bad", bad)
    if all_tiers:
        alike = rows.where("not _bad").withColumnsRenamed({"raw_description": "description", "raw_amount": "amount_minor", "raw_date": "booked_date"})
        rows = rows.join(identity.resolve(alike, stored), "id", "left")
    else:
        known = stored.select("fingerprint").distinct().withColumn("_known", F.lit(3))
        null = {"needs_review": F.lit(False), "stored_id": F.lit(None).cast("long"), "score": F.lit(None).cast("decimal(3,2)")}
        rows = rows.join(known, "fingerprint", "left").withColumn("tier", F.coalesce("_known", F.lit(0))).drop("_known").withColumns(null)
    if categories is not None:
        filed = categories.groupBy("raw_description").agg(F.min("category_id").alias("filed_under"))
        rows = rows.join(filed, "raw_description", "left")
    else:
        rows = rows.withColumn("filed_under", F.lit(None).cast("long"))
    rows = posting.based(posting.with_rate(rows, rates, currencies=currencies)).withColumnRenamed("refusal", "_unposted")
    fresh = ~F.col("_bad") & (F.coalesce("tier", F.lit(0)) == 0)
    rows = rows.withColumn("_is_payment", fresh & F.coalesce(F.col("is_card_payment"), F.lit(False)))
    # One row at most.
    rows = rows.join(F.broadcast(posting.contra_account(accounts).withColumnRenamed("id", "contra_id")), F.lit(True), "left")
    # The ranks, fingerprints and joins up to here are made once: card payments, which are a part of the rows, and the rows
    # themselves are read from what checkpoint() keeps in the folder that the cluster shares.
    rows = rows.checkpoint()
    payments = rows.where("_is_payment").select("id", "line_number", "account_id", F.col("raw_amount").alias("amount"), "currency", F.col("raw_date").alias("date"), "_unposted", *[c for c in ("explicit_id",) if c in rows.columns])
    payments = cards.with_roles(payments, accounts).withColumn("refusal", F.coalesce("refusal", "_unposted"))
    payments = payments.select("id", "line_number", "account_id", "amount", "currency", "date", "card_id", "paying_id", "refusal").checkpoint()
    decided = cards.post_card_payments(payments, halves).withColumnsRenamed({"shape": "_shape", "reason": "_reason"})
    rows = rows.join(decided.join(payments.select("id", "card_id", "paying_id"), "id"), "id", "left")

    plain = F.when(F.col("contra_id").isNull(), "no contra account").otherwise(F.col("_unposted"))
    reason = F.when(F.col("_bad"), UNATTRIBUTED).when(~fresh, F.lit(None)).when(F.col("_is_payment"), F.col("_reason")).otherwise(plain)
    outcome = F.when(F.col("_bad"), "failed").when(F.col("needs_review"), "review").when(~fresh, "duplicated").when(reason.isNull(), "created").otherwise("failed")
    shape = F.when(outcome == "created", F.when(F.col("_is_payment"), F.col("_shape")).otherwise("posted"))
    judged = rows.withColumns({"outcome": outcome, "shape": shape, "reason": reason, "refusal": F.col("_unposted")})
    return Imported(judged.drop("_bad", "_unposted", "_is_payment", "_shape", "_reason", "explicit_id"))


# The whole of it, under one commit ------------------------------------------------------------------


def halves_of(lines: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """The ledger's lines as card payments see them: dated, with whether they are made up, matched, or an expense (a line of a
    plain entry on an asset account)."""
    dated = entries.select(F.col("id").alias("entry_id"), F.col("entry_date").alias("date"), "is_transfer")
    nature = accounts.select(F.col("id").alias("account_id"), "account_nature")
    expense = ~F.col("is_transfer") & (F.col("account_nature") == "asset")
    return lines.join(dated, "entry_id").join(nature, "account_id", "left").select(
        "id", "entry_id", "account_id", "amount", "currency", "date", F.coalesce("is_synthesized", F.lit(False)).alias("is_synthesized"),
        F.col("transfer_match_id").isNotNull().alias("is_matched"), F.coalesce(expense, F.lit(False)).alias("is_expense"),
    )


def line_id(entry: Column, order: Column) -> Column:
    """The id of a line of an import; lines that a rewrite makes have the negative of the one that stays."""
    return entry * 2 + order


@dataclass(frozen=True)
class Booked:
    """What an import changes in the ledger: lines and entries that are new or differ, lines that go, matches, and new reviews."""

    lines: DataFrame
    dropped: DataFrame
    entries: DataFrame
    matches: DataFrame
    reviews: DataFrame


def _book(done: Imported, lines: DataFrame, entries: DataFrame, accounts: DataFrame, halves: DataFrame, asked: DataFrame) -> Booked:
    """Post what was judged onto a ledger's lines and entries: new legs, rewrites, links of card payments and of transfers.
    asked: out_id of reviews that are open."""
    touched = done.touched
    new = done.lines.withColumns({"id": line_id(F.col("entry_id"), F.col("sort_order")), "transfer_match_id": F.lit(None).cast("long")}).select(*lines.columns)
    old = lines.join(touched.select("entry_id").distinct(), "entry_id", "left_semi").select(*lines.columns)
    rewritten = cards.rewritten_lines(old.withColumn("is_expense", F.lit(False)), done.judged.select("id", "card_id"), touched).drop("is_expense")
    # What several tables below are read from is written to the cluster's shared folder, so that no plan holds it many times.
    changed = new.unionByName(rewritten).checkpoint()
    dropped = old.join(rewritten.select("id"), "id", "left_anti").select("id")

    # Both legs of a payment that one statement told are linked once the other statement tells it too.
    found = cards.card_links(touched, rewritten)
    nature = accounts.where("account_nature in ('asset', 'liability')").select(F.col("id").alias("account_id"))
    dates = done.entries.select(F.col("id").alias("entry_id"), F.col("entry_date").alias("date"))
    fresh = changed.where("not is_synthesized").join(dates, "entry_id")
    first, last = fresh.agg(F.min("date"), F.max("date")).first()
    near = max(abs(d) for d in TRANSFER_DAYS)
    free = halves.where("not is_matched and not is_synthesized").where(F.col("date").between(F.date_sub(F.lit(first), near), F.date_add(F.lit(last), near)))
    free = free.join(touched.select("entry_id").distinct(), "entry_id", "left_anti")
    legs = fresh.select("id", "entry_id", "account_id", "date", "amount", "currency").unionByName(free.select("id", "entry_id", "account_id", "date", "amount", "currency"))
    legs = legs.join(nature, "account_id", "left_semi").withColumnsRenamed({"id": "journal_line_id", "entry_id": "journal_entry_id", "date": "booked_date"})
    every = lines.join(changed.select("id"), "id", "left_anti").join(dropped, "id", "left_anti").select(*lines.columns).unionByName(changed).checkpoint()
    all_entries = entries.unionByName(done.entries)
    linked, queue = link_batch(legs, every.withColumnRenamed("entry_id", "journal_entry_id"), all_entries, open_reviews=asked, also=found)
    matches = linked.matches.checkpoint()

    stamp = matches.select(F.explode(F.array("out_id", "in_id")).alias("id"), F.col("id").alias("_match"))
    stamped = every.join(stamp, "id", "left").withColumn("transfer_match_id", F.coalesce("_match", "transfer_match_id"))
    moved = stamped.where("_match is not null").select(F.col("entry_id").alias("id")).union(touched.select(F.col("entry_id").alias("id"))).distinct()
    flagged = all_entries.join(moved.withColumn("_moved", F.lit(True)), "id", "left").withColumn("is_transfer", F.col("is_transfer") | F.coalesce("_moved", F.lit(False)))
    return Booked(
        stamped.join(changed.select("id").union(stamp.select("id")).distinct(), "id", "left_semi").select(*lines.columns).checkpoint(), dropped,
        flagged.join(done.entries.select("id").union(moved).distinct(), "id", "left_semi").select(*entries.columns).checkpoint(), matches,
        done.reviews.select("id", F.lit("identity").alias("reason"), F.array("stored_id").alias("candidates")).unionByName(queue.select(F.col("out_id").alias("id"), "reason", "candidates")),
    )


def _report(done: Imported, batch_id: str) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counts = done.judged.agg(F.count("*").alias("record_count"), *[count(o) for o in ("created", "duplicated", "review", "failed")]).withColumn("id", F.lit(batch_id))
    status = F.when(F.col("record_count") == 0, "failed").when(F.col("created") + F.col("duplicated") == F.col("record_count"), "completed").otherwise("partial")
    return counts.withColumn("status", status)


def _open_reviews(store: LedgerStore, version: Version) -> DataFrame:
    return store.read("reviews", version).where("reason in ('multi_candidate', 'low_confidence')").select(F.col("id").alias("out_id"))


def import_into(
    store: LedgerStore, batch_id: str, records: DataFrame, accounts: DataFrame, rates: DataFrame, categories: DataFrame | None = None, currencies: DataFrame | None = None
) -> int:
    """Import records (ids that the store doesn't have) and publish rows, entries, lines, links, reviews and the batch's report
    in one commit; the version's number. Raises Refused, and publishes nothing, if an entry wouldn't balance."""
    base = store.version()
    lines, entries = store.read("lines", base), store.read("entries", base)
    halves = halves_of(lines, entries, accounts)
    done = import_batch(records, store.read("rows", base), accounts, rates, halves, categories, currencies=currencies)
    # Judged once; all tables below are read from it. checkpoint() keeps it in the folder that the cluster shares.
    done = Imported(done.judged.checkpoint())
    booked = _book(done, lines, entries, accounts, halves, _open_reviews(store, base))
    return store.commit({
        "rows": Change(done.rows), "entries": Change(booked.entries), "lines": Change(booked.lines, booked.dropped), "matches": Change(booked.matches),
        "reviews": Change(booked.reviews), "batches": Change(_report(done, batch_id)),
    }, base)


class ReplayRefused(Exception):
    """The archived input doesn't parse to the rows that are stored; the counts are in `differences`."""

    def __init__(self, differences: dict[str, int]) -> None:
        super().__init__(f"replay refused: {differences}")
        self.differences = differences


def replay_into(
    store: LedgerStore, batch_id: int, records: DataFrame, accounts: DataFrame, rates: DataFrame, categories: DataFrame | None = None, currencies: DataFrame | None = None
) -> int | None:
    """Rebuild a batch's side of the ledger from the records that its archived input parses to, in one commit.

    The records must be the batch's rows, by fingerprint and one each, else ReplayRefused. Entries that no other batch's row
    points at go, with their lines and matches (a line matched with one of them is free again); the batch's rows are posted anew
    under their old ids, card payments and transfers are linked, and each line takes the category of a sure rule (categories:
    raw_description, category_id) or else the one it had. Lines of entries shared with another batch stay as they are. None, and
    no version, if nothing differs."""
    base = store.version()
    rows, lines, entries, matches = (store.read(t, base) for t in ("rows", "lines", "entries", "matches"))
    of_batch = F.col("batch_id") == batch_id
    mine = rows.where(of_batch)
    ranked = identity.with_fingerprint(identity.occurrence_index(records))
    there = F.coalesce("there", F.lit(False))
    both = ranked.groupBy("fingerprint").agg(F.count("*").alias("n")).join(mine.select("fingerprint", F.lit(True).alias("there")), "fingerprint", "full_outer")
    counts = both.agg(F.count_if(~there).alias("extra"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(there & (F.col("n") > 1)).alias("repeated")).first().asDict()
    if any(counts.values()):
        raise ReplayRefused(counts)

    sources = rows.where("entry_id is not null").select("id", "entry_id", "batch_id")
    kept_lines, kept_entries = detached(lines.withColumnRenamed("entry_id", "journal_entry_id"), entries, sources, of_batch)
    kept_lines = kept_lines.withColumnRenamed("journal_entry_id", "entry_id").select(*lines.columns)
    shared = kept_entries.join(sources.where(of_batch).select(F.col("entry_id").alias("id")).distinct(), "id", "left_semi").select("id")
    gone_lines = lines.join(kept_lines.select("id"), "id", "left_anti").select("id")
    ends = matches.select("id", F.explode(F.array("out_id", "in_id")).alias("line"))
    gone_matches = ends.join(gone_lines.withColumnRenamed("id", "line"), "line", "left_semi").select("id").distinct()
    lost = gone_matches.withColumnRenamed("id", "transfer_match_id").withColumn("_lost", F.lit(True))
    kept_lines = kept_lines.join(lost, "transfer_match_id", "left").withColumn("transfer_match_id", F.when(F.col("_lost").isNull(), F.col("transfer_match_id"))).checkpoint()
    kept_entries = kept_entries.checkpoint()
    freed = kept_lines.where("_lost").select(*lines.columns)
    kept_lines = kept_lines.select(*lines.columns)

    # The records under the ids of their rows; those of shared entries are not posted again.
    known = mine.select("fingerprint", F.col("id").alias("_id"), F.col("entry_id").alias("_entry"))
    again = ranked.drop("id", "occurrence_index").join(known, "fingerprint").join(shared.withColumnRenamed("id", "_entry"), "_entry", "left_anti")
    again = again.withColumnRenamed("_id", "id").select(*records.columns)
    before = mine.select(F.col("id").alias("_row"), "entry_id").join(lines.where("category_id is not null").select("entry_id", F.col("account_id").alias("_at"), F.col("category_id").alias("_was")), "entry_id")
    before = before.groupBy("_row", "_at").agg(F.min("_was").alias("_was"))
    halves = halves_of(kept_lines, kept_entries, accounts)
    done = import_batch(again, rows.where(~of_batch), accounts, rates, halves, categories, currencies=currencies)
    judged = done.judged.join(before, (F.col("id") == F.col("_row")) & (F.col("account_id") == F.col("_at")), "left").withColumn("filed_under", F.coalesce("filed_under", "_was")).drop("_row", "_at", "_was")
    done = Imported(judged.checkpoint())
    booked = _book(done, kept_lines, kept_entries, accounts, halves, _open_reviews(store, base))
    free_still = freed.join(booked.lines.select("id"), "id", "left_anti").join(booked.dropped, "id", "left_anti").select(*lines.columns)
    gone_entries = entries.join(kept_entries.select("id"), "id", "left_anti").select("id")
    changes = {
        "rows": (rows, done.rows, None), "entries": (entries, booked.entries, gone_entries), "lines": (lines, booked.lines.unionByName(free_still), gone_lines.union(booked.dropped)),
        "matches": (matches, booked.matches, gone_matches), "reviews": (store.read("reviews", base), booked.reviews, None),
    }
    # Only what differs is written; what goes and comes back as it was is no change.
    differing = {name: Change(_differing(now, table).checkpoint(), _not_back(gone, now)) for name, (table, now, gone) in changes.items()}
    differing = {name: c for name, c in differing.items() if not c.rows.isEmpty() or (c.gone is not None and not c.gone.isEmpty())}
    return store.commit(differing, base) if differing else None


def _differing(now: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of now that before doesn't have as they are."""
    typed = now.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema.fields])
    was = before.select(F.col("id").alias("_id"), F.struct(*before.columns).alias("_was"))
    return typed.join(was, F.col("id") == F.col("_id"), "left").where(~F.struct(*before.columns).eqNullSafe(F.col("_was"))).select(*before.columns)


def _not_back(gone: DataFrame | None, now: DataFrame) -> DataFrame | None:
    return None if gone is None else gone.join(now.select("id"), "id", "left_anti")


# Links ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Linked:
    matches: DataFrame
    lines: DataFrame
    entries: DataFrame


def write_links(links: DataFrame, lines: DataFrame, entries: DataFrame) -> Linked:
    """Links (out_id, in_id, method, confidence) made visible: a match row each, its id on both lines, both entries flagged.

    A match takes the id of its outbound line, which is in one match at most; so ids are the same in a replay. Links of a
    line to itself, of lines that are not there or already matched, and second links of a line are refused: they are left
    out of all three."""
    free = lines.where("transfer_match_id is null").select("id")
    there = links.where("out_id <> in_id").join(free.withColumnRenamed("id", "out_id"), "out_id", "left_semi").join(free.withColumnRenamed("id", "in_id"), "in_id", "left_semi").dropDuplicates(["out_id", "in_id"])
    ends = there.select("out_id", "in_id", F.explode(F.array("out_id", "in_id")).alias("end"))
    twice = ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select("end")
    spoiled = ends.join(twice, "end", "left_semi").select("out_id", "in_id").distinct()
    sound = there.join(spoiled, ["out_id", "in_id"], "left_anti")
    matches = sound.select(F.col("out_id").alias("id"), "out_id", "in_id", "method", "confidence")
    stamp = matches.select(F.explode(F.array("out_id", "in_id")).alias("_line"), F.col("id").alias("_match"))
    stamped = lines.join(stamp, lines["id"] == stamp["_line"], "left").select(*[F.coalesce("_match", c).alias(c) if c == "transfer_match_id" else F.col(c) for c in lines.columns])
    moved = stamped.where("transfer_match_id is not null").select(F.col("journal_entry_id").alias("_entry")).distinct().withColumn("_moved", F.lit(True))
    flagged = entries.join(moved, entries["id"] == moved["_entry"], "left").select(*[(F.col(c) | F.coalesce("_moved", F.lit(False))).alias(c) if c == "is_transfer" else F.col(c) for c in entries.columns])
    return Linked(matches, stamped, flagged)


def link_batch(
    legs: DataFrame, lines: DataFrame, entries: DataFrame, skipped: DataFrame | None = None, open_reviews: DataFrame | None = None, also: DataFrame | None = None
) -> tuple[Linked, DataFrame]:
    """Link the free legs greedily and write the links, with those of `also`; also the new reviews (out_id, reason, candidates).

    An outbound leg whose review is open (open_reviews: out_id) is not asked about again."""
    if open_reviews is not None:
        legs = legs.join(open_reviews.select(F.col("out_id").alias("journal_line_id")), "journal_line_id", "left_anti")
    found = transfers.greedy_links(legs, skipped)
    exact = F.expr("0.95BD").cast("decimal(3,2)")
    links = found.where("outcome = 'match'").select("out_id", F.element_at("in_ids", 1).alias("in_id"), F.lit("auto_amount_date").alias("method"), exact.alias("confidence"))
    links = links if also is None else links.unionByName(also)
    queue = found.where("outcome <> 'match'").select("out_id", F.col("outcome").alias("reason"), F.col("in_ids").alias("candidates"))
    return write_links(links, lines, entries), queue


def confirmed_links(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The links of reviews that are confirmed, for write_links."""
    sure = F.expr("1.00BD").cast("decimal(3,2)")
    return transfers.decide(queue, decisions).where("status = 'confirmed'").select("out_id", "in_id", F.lit("manual").alias("method"), sure.alias("confidence"))


# Replay --------------------------------------------------------------------------------------------


def detached(lines: DataFrame, entries: DataFrame, sources: DataFrame, batch: Column) -> tuple[DataFrame, DataFrame]:
    """lines and entries without those that only the rows of a batch (a condition on sources: id, entry_id, batch_id) hold."""
    held = sources.where(~batch).select(F.col("entry_id").alias("_held")).distinct()
    gone = sources.where(batch).select(F.col("entry_id").alias("_gone")).distinct().join(held, F.col("_gone") == F.col("_held"), "left_anti")
    return lines.join(gone, lines["journal_entry_id"] == gone["_gone"], "left_anti"), entries.join(gone, entries["id"] == gone["_gone"], "left_anti")


def replayed(records: DataFrame, before: DataFrame, recomputed: DataFrame) -> DataFrame:
    """fingerprint, state and category of each row after a replay.

    before: fingerprint, category_id as stored; recomputed: fingerprint, category_id as a rule that is sure gives it now, null
    where none is; records: the fingerprints that the archived input parses to, one row each. A sure rule wins, also over a
    category that was set by hand; where none is, the category before comes back. state: same, recategorised, restored (no
    rule, and there was a category), or, where input and store don't agree on the row, missing, extra or repeated (its
    fingerprint is parsed more than once)."""
    stored = before.select("fingerprint", F.col("category_id").alias("old"), F.lit(True).alias("was"))
    fresh = recomputed.groupBy("fingerprint").agg(F.min("category_id").alias("new"))
    now = records.groupBy("fingerprint").agg(F.count("*").alias("parsed")).join(fresh, "fingerprint", "left")
    both = stored.join(now, "fingerprint", "full_outer")
    state = (
        F.when(F.col("parsed").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("parsed") > 1, "repeated")
        .when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("new").isNull(), "restored").otherwise("recategorised")
    )
    return both.select("fingerprint", state.alias("state"), F.when(F.col("parsed").isNull(), F.col("old")).otherwise(F.coalesce("new", "old")).alias("category_id"))


def may_replay(states: DataFrame) -> DataFrame:
    """One row: the counts of each state, and whether the replay may be written (no row missing, extra or repeated)."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    counts = states.agg(*[count(s) for s in ("same", "recategorised", "restored", "missing", "extra", "repeated")])
    return counts.withColumn("accepted", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))
