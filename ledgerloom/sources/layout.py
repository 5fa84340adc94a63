"""Statements as layout text: one row per line (file, line_no, text) becomes one record per transaction.

A line's meaning depends on lines above it: a running count numbers the transactions, and the last header seen
places the columns. That state is carried by windows over blocks of a file's lines, each block starting from the
state that those before it leave, so that a long file is dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import infer_year, month_name_date, parse_date, pivot_year
from ..functions.text import IBAN_COMPACT, dutch_minor, english_minor


#: Line numbers of a file that one window holds at most.
LINE_BLOCK = 65_536


def _carried(lines: DataFrame, *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """lines with running sums, and with last values that aren't null, up to each line of its file.

    Windows are over blocks of LINE_BLOCK line numbers; what is windowed by file has a row for each block."""
    sums, lasts = sums or {}, lasts or {}
    in_block = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.floor(F.col("line_no") / LINE_BLOCK), F.lit(-(1 << 62)))
    marked = lines.withColumns({"_block": block} | {f"_{n}": c for n, c in (sums | lasts).items()})
    ends = marked.groupBy(F.col("file").alias("_file"), F.col("_block").alias("_at")).agg(
        *[F.sum(f"_{n}").alias(f"_end_{n}") for n in sums], *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line_no"))).alias(f"_end_{n}") for n in lasts],
    )
    starts = ends.select("_file", "_at", *[F.sum(f"_end_{n}").over(before).alias(f"_start_{n}") for n in sums], *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_start_{n}") for n in lasts])
    within = marked.withColumns({f"_{n}": F.sum(f"_{n}").over(in_block) for n in sums} | {f"_{n}": F.last(f"_{n}", ignorenulls=True).over(in_block) for n in lasts})
    joined = within.join(starts, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_block") == F.col("_at")))
    zero = F.lit(0)
    so_far = {n: F.coalesce(f"_{n}", zero) + F.coalesce(f"_start_{n}", zero) for n in sums} | {n: F.coalesce(f"_{n}", f"_start_{n}") for n in lasts}
    return joined.select(*[c for c in lines.columns if c not in so_far], *[c.alias(n) for n, c in so_far.items()])


#: With points between thousands, or without any.
DUTCH_AMOUNT = r"(?:^|[^\d.,])(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})\s*$"
CARD_START = r"^\s*(\d{2}\.\d{2}\.\d{2})\s+(\d{2}\.\d{2}\.\d{2})\s+(.*)$"
CHECKING_START = r"^\s*(\d{2})-(\d{2})\s+([a-z]{2})\s+(.*)$"
SUB_FIELD = r"^\s+([A-Z][A-Za-z /]*[A-Za-z]):\s+(\S.*)$"
SECTION_START = r"^\s*(\d{1,2} [A-Za-z]{3,4} \d{4})\s{2,}(\S.*)$"
EURO = r"(€[0-9,]+\.\d{2})"

# Printed wordings. What a footer begins and ends with; headings of a card statement (alone, or before a blank) and
# lines of it that belong to no row; and headings of its legal parts.
FOOTER_START, FOOTER_END = r"(?i)^\s*report lost or stolen", r"(?i)page \d+ of \d+"
CARD_HEADINGS = (
    "payments", "transactions", "card summary", "activity", "new balance", "previous balance", "payment due", "credit limit", "available credit", "page", "continued", "date",
    "description", "amount",
)
CARD_FURNITURE = (
    "American Express Europe S.A. gevestigd", "Nieuwe transacties voor:", "Is het adres onjuist?", "Het te betalen bedrag is met", "Totaal voor:",
    "Overige Transacties:", "Totaal Overige Transacties :",
)
LEGAL_HEADINGS = (
    "belangrijke informatie", "handmatig betalen", "automatische incasso", "online services", "correspondentieadres", "bankgegevens", "zakelijke uitgaven",
    "american express app", "the gold card", "maandafrekening", "pagina", "datum volgende", "membership rewards classic", "membership rewards nummer",
    "totaal aantal gespaarde punten", "identificatienummer", "u kunt het adres", "mevr ",
)


def _day(x: Column) -> Column:
    """dd.MM.yy with a pivot for the century."""
    year = pivot_year(F.substr(x, F.lit(7), F.lit(2)).cast("int")).cast("string")
    return parse_date(F.concat(F.substr(x, F.lit(1), F.lit(6)), year))


def _rows_of(lines: DataFrame, start: str, stop: Column) -> DataFrame:
    """Lines inside rows, with start and row: a line like `start` opens one, and a line that stops it ends what is added to it."""
    started = lines.withColumn("start", F.col("text").rlike(start))
    numbered = _carried(started, sums={"row": F.col("start").cast("long")}).where("row > 0")
    in_row = Window.partitionBy("file", "row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max((stop & ~F.col("start")).cast("int")).over(in_row)
    return numbered.withColumn("_stopped", stopped).where((F.col("_stopped") == 0) & (F.trim("text") != "")).drop("_stopped")


def _joined(*pieces: Column) -> Column:
    """The texts of a group's lines in order (null pieces left out)."""
    of_line = F.array_sort(F.collect_list(F.when(F.coalesce(*pieces).isNotNull() & (F.coalesce(*pieces) != ""), F.struct("line_no", F.coalesce(*pieces).alias("piece")))))
    return F.array_join(F.transform(of_line, lambda p: p["piece"]), " ")


def _card_rows(lines: DataFrame) -> DataFrame:
    text = F.col("text")
    low = F.regexp_replace(F.lower(F.trim(text)), ":+$", "")
    skipped = low.isin(*CARD_HEADINGS)
    for wording in CARD_HEADINGS:
        skipped = skipped | F.startswith(low, F.lit(f"{wording} "))
    for wording in CARD_FURNITURE:
        skipped = skipped | F.contains(text, F.lit(wording))
    plain, legal = F.translate(low, "®™", ""), F.lit(False)
    for wording in LEGAL_HEADINGS:
        legal = legal | F.startswith(plain, F.lit(wording))
    amount = F.when(text.rlike(DUTCH_AMOUNT), F.regexp_extract(text, DUTCH_AMOUNT, 1))
    inside = _rows_of(lines.where(~skipped), CARD_START, legal & amount.isNull())
    credit = ~F.col("start") & (F.trim("text") == "CR")
    words = F.when(F.col("start"), F.trim(F.regexp_replace(F.regexp_extract(text, CARD_START, 3), DUTCH_AMOUNT, ""))).otherwise(F.trim(text))
    part = lambda k: F.max(F.when(F.col("start"), F.regexp_extract("text", CARD_START, k)))
    return inside.groupBy("file", "row").agg(
        F.min("line_no").alias("line_no"), part(1).alias("booked"), part(2).alias("processed"), F.max(F.when(F.col("start"), amount)).alias("amount"),
        F.bool_or(credit).alias("credit"), _joined(F.when(~credit, words)).alias("description"),
    )


def card_statement(lines: DataFrame) -> DataFrame:
    """file, row, booked_date, processing_date, description, amount_minor of card statements.

    Two dates open a row, whose amount ends that line; other lines add to the description as they are, and a bare CR turns the
    row into a credit. Headings and furniture are passed over; a legal heading without an amount ends what is added to a row.
    Rows without an amount are in card_failures."""
    sign = F.when(F.col("credit"), F.lit(1)).otherwise(F.lit(-1))
    return _card_rows(lines).where("amount is not null").select(
        "file", "row", _day(F.col("booked")).alias("booked_date"), _day(F.col("processed")).alias("processing_date"), "description", (sign * dutch_minor(F.col("amount"))).alias("amount_minor"),
    )


def card_failures(lines: DataFrame) -> DataFrame:
    """file, row, line_no, reason of rows that a card statement prints and card_statement can't read."""
    rows = _card_rows(lines)
    reason = F.when(F.col("amount").isNull(), "no amount").when(_day(F.col("booked")).isNull(), "no such date")
    return rows.select("file", "row", "line_no", reason.alias("reason")).where("reason is not null")


def _checking_rows(lines: DataFrame) -> DataFrame:
    heading = F.col("text").rlike(r"Debit amount.*Credit amount")
    middle = (F.instr("text", "Debit amount") + F.length(F.lit("Debit amount")) + F.instr("text", "Credit amount") + F.length(F.lit("Credit amount"))) / 2
    placed = _carried(lines, lasts={"middle": F.when(heading, middle)})
    inside = _rows_of(placed, CHECKING_START, heading)
    text, start = F.col("text"), F.col("start")
    amount = F.when(start & text.rlike(DUTCH_AMOUNT), F.regexp_extract(text, DUTCH_AMOUNT, 1))
    field = F.when(~start & text.rlike(SUB_FIELD), F.struct(F.regexp_extract(text, SUB_FIELD, 1).alias("key"), F.trim(F.regexp_extract(text, SUB_FIELD, 2)).alias("value")))
    words = F.trim(F.when(start, F.regexp_replace(F.regexp_extract(text, CHECKING_START, 4), DUTCH_AMOUNT, "")).otherwise(text))
    part = lambda k: F.max(F.when(start, F.regexp_extract("text", CHECKING_START, k)))
    return inside.groupBy("file", "row").agg(
        F.min("line_no").alias("line_no"), part(1).alias("day"), part(2).alias("month"), part(3).alias("type_code"), F.max(amount).alias("amount"),
        F.max(F.when(start, F.length(F.rtrim("text")) <= F.col("middle"))).alias("debit"), _joined(F.when(field.isNull(), words)).alias("description"),
        F.array_sort(F.collect_list(F.when(field.isNotNull(), F.struct("line_no", field.alias("field"))))).alias("fields"),
    )


def checking_statement(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """file, row, booked_date, type_code, description, amount_minor, fields of checking statements with a period.

    A day, a month and a type code open a row. Whether it is a debit depends on where its amount ends against the middle of the
    two amount headings, which every page prints anew. Later lines `Name: value` are the row's fields (the first of a name
    stays), others add to the description. Rows without an amount or heading are in checking_failures."""
    year = infer_year(F.col("month").cast("int"), start, end).cast("string")
    sign = F.when(F.col("debit"), F.lit(-1)).otherwise(F.lit(1))
    of_name = F.transform("fields", lambda f: f["field"])
    names = F.array_distinct(F.transform(of_name, lambda f: f["key"]))
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(of_name, lambda f: f["key"] == n), F.lit(0))["value"]))
    return _checking_rows(lines).where("amount is not null and debit is not null").select(
        "file", "row", parse_date(F.concat_ws("-", year, "month", "day")).alias("booked_date"), "type_code", "description", (sign * dutch_minor(F.col("amount"))).alias("amount_minor"), fields.alias("fields"),
    )


def checking_failures(lines: DataFrame) -> DataFrame:
    reason = F.when(F.col("amount").isNull(), "no amount").when(F.col("debit").isNull(), "no heading of amounts")
    return _checking_rows(lines).select("file", "row", "line_no", reason.alias("reason")).where("reason is not null")


def classified(position: Column, out: Column, into: Column, close: Column) -> Column:
    """out, in or close: the column whose heading's offset a token is nearest to, by the middles between neighbours."""
    return F.when(position < (out + into) / 2, "out").when(position < (into + close) / 2, "in").otherwise("close")


def _with_furniture(lines: DataFrame, headers: str | None) -> DataFrame:
    """lines with is_furniture: a footer goes from its first marker through the page number; running headers are whole lines."""
    starts, ends = F.col("text").rlike(FOOTER_START), F.col("text").rlike(FOOTER_END)
    event = F.when(starts & ~ends, F.lit("in")).when(ends, F.lit("out"))
    running = F.col("text").rlike(headers) if headers else F.lit(False)
    followed = _carried(lines, lasts={"_state": event})
    return followed.withColumn("is_furniture", ends | (F.coalesce("_state", F.lit("out")) == "in") | running).drop("_state")


def without_furniture(lines: DataFrame, headers: str | None = None) -> DataFrame:
    """Lines outside footers and running headers (a pattern of whole lines)."""
    return _with_furniture(lines, headers).where("not is_furniture").drop("is_furniture")


def furniture_dropped(lines: DataFrame, headers: str | None = None) -> DataFrame:
    """file, dropped: how many lines of each file are furniture."""
    return _with_furniture(lines, headers).groupBy("file").agg(F.count_if("is_furniture").alias("dropped"))


def _sectioned_rows(lines: DataFrame, headers: str | None) -> DataFrame:
    section = F.regexp_extract("text", r"(?i)^\s*(.+?) transactions\b", 1)
    heading = F.col("text").rlike(r"Money out\s+Money in\s+Balance")
    kept = without_furniture(lines, headers)
    places = {name: F.when(heading, F.instr("text", label)) for name, label in (("out_at", "Money out"), ("in_at", "Money in"), ("close_at", "Balance"))}
    kept = _carried(kept, lasts=places | {"section": F.when(section != "", F.lower(section))})
    inside = _rows_of(kept, SECTION_START, heading | (section != ""))
    text, start = F.col("text"), F.col("start")
    amounts = F.when(start, F.regexp_extract_all("text", F.lit(EURO), F.lit(1)))
    field = lambda name: F.max(F.when(~start, F.nullif(F.trim(F.regexp_extract(text, rf"(?i)^\s*{name}:\s*(.*)$", 1)), F.lit(""))))
    first = lambda c: F.max(F.when(start, c))
    return inside.groupBy("file", "row").agg(
        F.min("line_no").alias("line_no"), first(F.col("section")).alias("section"), first(F.regexp_extract("text", SECTION_START, 1)).alias("day"),
        first(F.trim(F.regexp_extract(F.regexp_extract("text", SECTION_START, 2), r"^([^€]*)", 1))).alias("description"), F.max(amounts).alias("amounts"), first(F.instr("text", "€")).alias("at"),
        *[first(F.col(c)).alias(c) for c in ("out_at", "in_at", "close_at")], field("To").alias("to"), field("From").alias("from"), field("Reference").alias("reference"),
    )


def sectioned_statement(lines: DataFrame, headers: str | None = None) -> DataFrame:
    """file, section, row, booked_date, description, amount_minor, balance_minor, to, from, reference of statements with
    several products.

    A heading `... transactions` opens a section, a heading of columns places money out, money in and balance. Of a row's
    amounts the last is the balance, the first is out or in by its place. Lines To, From and Reference belong to the row above.
    Rows without an amount in a money column are in sectioned_failures."""
    side = classified(F.col("at"), F.col("out_at"), F.col("in_at"), F.col("close_at"))
    sign = F.when(side == "out", F.lit(-1)).otherwise(F.lit(1))
    return _sectioned_rows(lines, headers).where(F.size("amounts") > 1).select(
        "file", "section", "row", month_name_date(F.col("day")).alias("booked_date"), "description", (sign * english_minor(F.get("amounts", F.lit(0)))).alias("amount_minor"),
        english_minor(F.element_at("amounts", -1)).alias("balance_minor"), "to", "from", "reference",
    )


def sectioned_failures(lines: DataFrame, headers: str | None = None) -> DataFrame:
    return _sectioned_rows(lines, headers).where(F.size("amounts") < 2).select("file", "row", "line_no", F.lit("no amount in a money column").alias("reason"))


def with_section_accounts(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with the account_id that a mapping (section, account_id) names for their section; null for others."""
    return rows.join(mapping.where("error is null").select("section", "account_id") if "error" in mapping.columns else mapping.select("section", "account_id"), "section", "left")


def section_map(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """section, account_id, error of JSON objects (column sections): names without case, positive ids; a name twice with
    different ids, an unknown name or anything else is an error."""
    parsed = rows.select("sections", F.from_json("sections", "map<string,int>").alias("m"))
    pairs = parsed.select("sections", F.col("m").isNull().alias("bad"), F.explode_outer("m").alias("name", "account_id")).withColumn("section", F.lower(F.trim("name")))
    one = pairs.groupBy("sections", "section").agg(F.bool_or("bad").alias("bad"), F.min("account_id").alias("account_id"), F.max("account_id").alias("most"), F.count_if(F.col("account_id").isNull()).alias("n_null"))
    error = (
        F.when(F.col("bad") | (F.col("n_null") > 0), F.lit("not a map of sections to ids")).when(~F.col("section").isin(*known), F.lit("unknown section"))
        .when(F.col("account_id") < 1, F.lit("not an account")).when(F.col("account_id") != F.col("most"), F.lit("section given twice"))
    )
    return one.select("section", "account_id", error.alias("error"))


def header_field(lines: DataFrame, label: str) -> DataFrame:
    """file, value: the text of the line below the first line that holds a label and has a digit below it."""
    below = F.lead("text").over(Window.partitionBy("file").orderBy("line_no"))
    found = lines.withColumn("below", below).where(F.contains("text", F.lit(label)) & F.col("below").rlike(r"\d"))
    return found.groupBy("file").agg(F.min_by(F.trim("below"), "line_no").alias("value"))


def statement_header(lines: DataFrame) -> DataFrame:
    """file, period_from, period_to, ibans, debit_total, credit_total, generated: what a statement says of itself.

    The period stands on one line (`Periode: ... tot ...`) or below its two labels; all of it is advice, nothing filters rows."""
    whole = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    printed = r"Periode:\s*(\d{2}\.\d{2}\.\d{4})\s+tot\s+(\d{2}\.\d{2}\.\d{4})"
    own = lambda k: parse_date(F.nullif(F.regexp_extract("text", printed, k), F.lit("")))
    out = whole.select(
        "file", own(1).alias("_from"), own(2).alias("_to"), F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", r"(?<=[A-Z0-9]) (?=[A-Z0-9]{2,4}\b)", ""), F.lit(IBAN_COMPACT), F.lit(1))).alias("ibans"),
        F.nullif(F.trim(F.regexp_extract("text", r"Generated on the ([^\n]*)", 1)), F.lit("")).alias("generated"),
    )
    dutch = F.regexp_extract_all("value", F.lit(r"(\d{1,3}(?:\.\d{3})*,\d{2})"), F.lit(1))
    for label, name in (("From (date)", "_below_from"), ("To (date)", "_below_to"), ("Total amount debited", "_totals")):
        value = header_field(lines, label)
        value = value.select("file", (dutch if name == "_totals" else parse_date(F.regexp_extract("value", r"(\S+)", 1))).alias(name))
        out = out.join(value, "file", "left")
    return out.select(
        "file", F.coalesce("_from", "_below_from").alias("period_from"), F.coalesce("_to", "_below_to").alias("period_to"), "ibans",
        dutch_minor(F.get("_totals", F.lit(0))).alias("debit_total"), dutch_minor(F.get("_totals", F.lit(1))).alias("credit_total"), "generated",
    )
