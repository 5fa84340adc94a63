"""The ledger operators against literal fixtures."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.functions import dates as fd
from ledgerloom.functions import money as fm
from ledgerloom.functions import text as ft
from ledgerloom.operators import analytics, cards, categorize, checks, identity, pairing, posting, statements, transfers
from ledgerloom.plans import importing, pipeline
from ledgerloom.plans.store import Change, Conflict, LedgerStore, Refused
from ledgerloom.sources import ais, layout, manual

D = dt.date


def one(spark, column, **values):
    """The value of a column expression over one row."""
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.values()) or (0,)], names).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def ledger(spark):
    accounts = spark.createDataFrame([(1, "asset"), (2, "asset"), (3, "liability"), (9, "equity")], "id long, account_nature string")
    categories = spark.createDataFrame([(10, None, "Groceries", "expense"), (11, None, "Internal transfer", "transfer")], "id long, parent_id long, name string, kind string")
    entries = spark.createDataFrame([(1, D(2026, 1, 5), False), (2, D(2026, 1, 5), False), (3, D(2026, 1, 10), True), (4, D(2026, 1, 10), True)], "id long, entry_date date, is_transfer boolean")
    legs = [(1, 1, 100000, None), (1, 9, -100000, None), (2, 3, -50000, 10), (2, 9, 50000, 10), (3, 1, -30000, 11), (3, 2, 30000, 11), (4, 1, -20000, 11), (4, 3, 20000, 11)]
    rows = [(i, e, a, m, "EUR", Decimal(m) / 100, c) for i, (e, a, m, c) in enumerate(legs)]
    lines = spark.createDataFrame(rows, "id long, journal_entry_id long, account_id long, amount long, currency string, amount_base decimal(18,4), category_id long")
    return lines, entries, accounts, categories


def test_net_worth(ledger):
    lines, entries, accounts, _ = ledger
    got = {r.date: r.amount for r in analytics.net_worth_daily(lines, entries, accounts, D(2026, 1, 4), D(2026, 1, 10)).collect()}
    assert got[D(2026, 1, 4)] == 0 and got[D(2026, 1, 5)] == got[D(2026, 1, 10)] == 50000 and len(got) == 7
    later = analytics.net_worth_daily(lines, entries, accounts, D(2026, 2, 1), D(2026, 2, 2)).collect()
    assert [r.amount for r in later] == [50000, 50000]
    with pytest.raises(ValueError):
        analytics.net_worth_daily(lines, entries, accounts, D(2026, 2, 1), D(2026, 1, 1))


def test_spend_and_cashflow(ledger):
    lines, entries, accounts, categories = ledger
    spend = analytics.spend_by_category(lines, entries, accounts, categories, D(2026, 1, 1), D(2026, 1, 31)).collect()
    assert [(r.name, r.amount) for r in spend] == [("Groceries", -50000)]
    flow = analytics.cashflow(lines, entries, accounts, D(2026, 1, 1), D(2026, 1, 31), "month").collect()
    assert [tuple(r) for r in flow] == [("2026-01", 100000, 20000, 80000)]


def test_category_cycles(spark):
    tree = spark.createDataFrame([(1, None, "a", "expense"), (2, 1, "b", "expense"), (3, 3, "c", "expense"), (4, 5, "d", "expense"), (5, 4, "e", "expense"), (6, 99, "f", "expense"), (7, 1, "g", "income")], "id long, parent_id long, name string, kind string")
    assert {r.id: r.root_id for r in analytics.category_roots(tree).collect()} == {1: 1, 2: 1, 3: 3, 4: 5, 5: 4, 6: 6, 7: 1}
    assert {r.id: r.reason for r in analytics.category_forest(tree).collect()} == {1: None, 2: None, 3: "cycle", 4: "cycle", 5: "cycle", 6: "not_listed", 7: "other_kind"}


def test_budget(spark):
    cases = [(0, 1000, 0), (100, 1000, 10), (999, 1000, 100), (1001, 1000, 100), (2500, 1000, 250), (500, 0, 0), (5, 1000, 0), (15, 1000, 2)]
    df = spark.createDataFrame(cases, "spent long, lim long, used long")
    remaining, over, used = analytics.budget_check(F.col("spent"), F.col("lim"))
    for r in df.select("*", remaining.alias("r"), over.alias("o"), used.alias("u")).collect():
        assert (r.r, r.o, r.u) == (r.lim - r.spent, r.spent > r.lim, r.used)


FINGERPRINT = "08304ec6ef2960bcef157f4c5515e404c04f816b1e5ee02453b90d4efddca6f1"


def _print(spark, description, amount=-1250, currency="EUR", date=D(2026, 3, 14), account="acc-001"):
    return one(spark, ft.fingerprint(F.col("d"), F.lit(amount), F.lit(currency), F.lit(date), F.lit(account), F.lit(1)), d=description)


def test_fingerprint(spark):
    assert _print(spark, "Albert Heijn 1234") == FINGERPRINT
    for suffix in (" *", " #", " *REF:0123456789", " #REF:1", " * #REF:2", " CARD:9876", " KAASACHTELNR:1234567", " #REF 000123", " *REF0123456", " REF 000123"):
        assert _print(spark, "albert  HEIJN 1234" + suffix) == FINGERPRINT, suffix
    assert _print(spark, "Albert Heijn 1235") != FINGERPRINT and _print(spark, "Albert Heijn 1234", amount=1250) != FINGERPRINT
    assert _print(spark, "Cafe REFACTOR 1234") != _print(spark, "Cafe 1234")


def test_markers_are_not_anchored(spark):
    assert one(spark, ft.normalised(F.col("d")), d="A CARD:98 middle") == "amiddle"
    assert one(spark, ft.normalised(F.lit(None).cast("string"))) == ""


def test_similarity_and_stems(spark):
    s = one(spark, ft.word_similarity(F.lit("albert heijn"), F.col("d")), d="albert hejin amsterdam")
    assert 0.6 < s and s > one(spark, ft.dice(F.lit("albert heijn"), F.col("d")), d="albert hejin amsterdam")
    assert one(spark, ft.dice(F.lit("ab"), F.col("d")), d="abc") == 0.0 and one(spark, ft.dice(F.lit("ab"), F.col("d")), d="AB") == 1.0
    for text, stem in (("PAYPAL XYZ 1234", "paypal xyz"), ("JUMBO 4321", "jumbo"), ("ALBERT HEIJN AMSTERDAM 1234 TERM9", "albert heijn amsterdam 1234"), ("1234 5678", "1234")):
        assert one(spark, ft.payee_stem(F.col("d")), d=text) == stem


def test_text_scalars(spark):
    assert one(spark, ft.redact_ibans(F.col("d")), d="to NL79 RABO 0000 0000 42 ok") == "to ...0042 ok"
    assert one(spark, ft.redact_cards(F.col("d")), d="card 123456******3456 and XXXX-XXXXXX-23007") == "card **** and ****"
    for text, number in (("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("12,5", "12.5"), ("1 000", "1000")):
        assert one(spark, ft.european_number(F.col("d")), d=text) == number
    assert one(spark, ft.english_minor(F.col("d")), d="€1,234.5") == 123450 and one(spark, ft.dutch_minor(F.col("d")), d="1.234,56") == 123456
    assert one(spark, ft.legend(F.col("d")), d="ac = acceptgiro  ba = pin  ac = x") == {"ac": "acceptgiro", "ba": "pin"}
    assert one(spark, ft.clean_currency(F.col("d")), d=" eur ") == "EUR" and one(spark, ft.clean_currency(F.col("d")), d="E1") is None


def test_dates(spark):
    for text in ("2026-03-05", "05/03/2026", "5-3-2026", "05.03.2026", "5 Mar 2026", "5 March 2026", "20260305"):
        assert one(spark, fd.parse_date(F.col("d")), d=text) == D(2026, 3, 5), text
    assert one(spark, fd.parse_date(F.col("d")), d="31.02.2026") is None
    assert one(spark, fd.month_name_date(F.col("d")), d="5 Sept 2025") == D(2025, 9, 5)
    assert one(spark, fd.infer_year(F.lit(12), F.lit(D(2025, 12, 20)), F.lit(D(2026, 1, 19)))) == 2025
    assert one(spark, fd.period(F.lit(D(2026, 3, 5)), "week")) == "2026-03-02"
    assert one(spark, fd.calendar(F.lit(D(2026, 1, 2)), F.lit(D(2026, 1, 1)))) == []


def test_money(spark):
    half = F.col("d").cast("decimal(18,4)")
    for text, cents in (("0.0050", 1), ("-0.0050", -1), ("1.2349", 123), ("-1.2350", -124)):
        assert one(spark, fm.cents(half), d=text) == cents
    assert one(spark, fm.display(F.lit(-123456789), 2, "€")) == "−€1,234,567.89" and one(spark, fm.display(F.lit(5), 0)) == "5"
    for text, minor in (("12,5", 1250), ("-0", 0), ("+3.07", 307), ("1.234", None), ("abc", None), ("99999999999999", None)):
        assert one(spark, fm.parse_signed(F.col("d")), d=text) == minor, text
    assert one(spark, fm.converted(F.lit(1000), F.expr("1.25BD"))) == Decimal("8.0000")


def _sides(spark, rows):
    schema = "id long, account_id long, amount_minor long, currency string, booked_date date, description string, provider_txn_id string, merchant_alias_id long, pending boolean, fingerprint string"
    return spark.createDataFrame(rows, schema)


def test_tiers(spark):
    day = D(2026, 3, 14)
    new = _sides(spark, [(1, 1, -850, "EUR", day, "jumbo 4321", "t1", 5, False, "f1"), (2, 1, -850, "EUR", day, "jumbo 4321", "", 5, False, "f2"), (3, 2, -100, "EUR", day, "x", "", None, False, "f3"), (4, 2, -777, "EUR", day, "y", "", None, False, "f4")])
    stored = _sides(spark, [(11, 1, -850, "EUR", day, "jumbo 4321", "t1", 5, True, "g"), (12, 3, -100, "EUR", day, "x", "", None, True, "f3"), (13, 1, -849, "EUR", D(2026, 3, 18), "z", "", 5, True, "h")])
    best = {r.new_id: (r.stored_id, r.score, r.decision) for r in identity.tier2_decisions(new, stored).collect()}
    assert best == {1: (11, Decimal("1.00"), "link"), 2: (11, Decimal("1.00"), "link")}
    assert {r.id: r.tier for r in identity.resolve(new, stored).collect()} == {1: 1, 2: 2, 3: 3, 4: 0}


def test_occurrence_index(spark):
    rows = [(i, d, -250, "EUR", D(2026, 1, 1), 1, i) for i, d in enumerate(["Coffee", "COFFEE *", "coffee", "Tea"])]
    df = spark.createDataFrame(rows, "id long, raw_description string, raw_amount long, currency string, raw_date date, account_id long, line_number long")
    ranked = identity.occurrence_index(df)
    assert {r.id: r.occurrence_index for r in ranked.collect()} == {0: 1, 1: 2, 2: 3, 3: 1}
    assert identity.with_fingerprint(ranked).select("fingerprint").distinct().count() == 4


def test_categorise_and_learn(spark):
    rules = spark.createDataFrame([(100, "heijn", 1), (500, "albert", 2)], "priority int, description_pattern string, category_id long")
    aliases = spark.createDataFrame([("kiosk", 3, "0.50")], "raw_string string, category_id long, confidence string")
    merchants = spark.createDataFrame([("Kiosk Central", 4), ("Bakery", 5), ("albert cuyp", 6)], "name string, category_id long")
    rows = spark.createDataFrame([("ALBERT HEIJN 1",), ("Kiosk Central 3",), ("the bakery",), ("bakerij bakers",), ("nothing",), (None,)], "description string")
    got = {r.description: (r.category_id, r.layer) for r in categorize.categorize(rows, rules, aliases, merchants).collect()}
    assert got["ALBERT HEIJN 1"] == (1, 1) and got["Kiosk Central 3"] == (3, 2) and got["the bakery"] == (5, 3)
    assert got["bakerij bakers"] == (5, 4) and got["nothing"] == (None, 7) and got[None] == (None, 7)
    hand = categorize.hand_rules(spark, [("jumbo", 9)])
    fixes = spark.createDataFrame([("JUMBO 4321", 7, 1), ("Jumbo 9", 8, 2)], "description string, category_id long, id long")
    learned = {(r.priority, r.description_pattern, r.category_id) for r in categorize.learn(hand, fixes).collect()}
    assert learned == {(100, "jumbo", 9), (500, "jumbo", 8)}


def _legs(spark, rows):
    return spark.createDataFrame(rows, "journal_line_id long, account_id long, booked_date date, amount long, currency string")


def test_transfers(spark):
    d = D(2026, 3, 15)
    legs = _legs(spark, [(1, 1, d, -5000, "EUR"), (2, 2, d, 5000, "EUR"), (3, 3, d, -700, "EUR"), (4, 4, d, 701, "EUR"), (5, 5, d, -900, "EUR"), (6, 6, d, 940, "USD"), (7, 1, d, 5000, "EUR"), (8, 8, D(2026, 3, 19), 5000, "EUR")])
    got = {(r.out_id, r.in_id, r.confidence) for r in transfers.scored(transfers.candidates(legs)).collect()}
    assert got == {(1, 2, Decimal("0.95")), (3, 4, Decimal("0.85")), (5, 6, Decimal("0.85"))}
    assert {r.out_id: r.outcome for r in transfers.outcomes(transfers.candidates(legs)).collect()} == {1: "match", 3: "low_confidence", 5: "low_confidence"}


def test_greedy_links_consume(spark):
    d = D(2026, 3, 15)
    # The first outbound leg could only take 10; the second would have had two candidates, but one is gone.
    legs = _legs(spark, [(1, 1, d, -5000, "EUR"), (2, 2, d, -5001, "EUR"), (10, 3, d, 5000, "EUR"), (11, 1, d, 5001, "EUR")])
    got = {r.out_id: (r.outcome, r.in_ids) for r in transfers.greedy_links(legs).collect()}
    assert got == {1: ("match", [10]), 2: ("match", [11])}


def test_greedy_links_in_rounds(spark, monkeypatch):
    # One component of some thousand pairs: no task may be given more than a hundred of them.
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 4), D(2026, 3, 1 + rng.randint(0, 19)), rng.choice((-1, 1)) * (5000 + 3 * rng.randint(0, 40)), rng.choice(("EUR", "EUR", "EUR", "USD"))) for i in range(500)]
    # A chain: each leg has one candidate once the leg before it has taken the other.
    rows += [(900 + k, 10 + k, D(2026, 5, 1), -9000 - k, "EUR") for k in range(8)] + [(1000 + k, 9 + k, D(2026, 5, 1), 9000 + k, "EUR") for k in range(8)]
    legs = _legs(spark, rows)
    pairs = transfers.scored(transfers.candidates(legs)).select("out_id", "in_id", "auto").collect()
    used, want = set(), {}
    for out_id in sorted({p.out_id for p in pairs}):
        free = sorted((p.in_id, p.auto) for p in pairs if p.out_id == out_id and p.in_id not in used)
        if len(free) == 1 and free[0][1]:
            used.add(free[0][0])
        if free:
            want[out_id] = ("match" if free[0][0] in used else "low_confidence" if len(free) == 1 else "multi_candidate", [i for i, _ in free])
    assert len(pairs) > 2000 and len(used) > 8
    replayed, replay = spark.sparkContext.accumulator(0), transfers._replay
    monkeypatch.setattr(transfers, "_replay", lambda pdf: (replayed.add(len(pdf)), replay(pdf))[1])
    for most in (0, 100):
        monkeypatch.setattr(transfers, "REPLAYED_PAIRS", most, raising=False)
        before = replayed.value
        assert {r.out_id: (r.outcome, r.in_ids) for r in transfers.greedy_links(legs).collect()} == want
        assert replayed.value - before <= most


def test_reviews(spark):
    d = D(2026, 3, 15)
    legs = _legs(spark, [(1, 1, d, -5000, "EUR"), (2, 2, d, 5000, "EUR"), (3, 3, d, 5001, "EUR")])
    queue = transfers.reviews(transfers.candidates(legs))
    assert [tuple(r) for r in queue.collect()] == [(1, "multi_candidate", [2, 3])]
    assert {(r.in_id, r.confidence) for r in transfers.review_items(queue, legs.where("journal_line_id <> 3")).collect()} == {(2, Decimal("0.95")), (3, Decimal("0.00"))}
    decided = transfers.decide(queue, legs.sparkSession.createDataFrame([(1, "confirm", 4)], "out_id long, action string, chosen long"))
    assert [(r.status, r.in_id) for r in decided.collect()] == [("refused", None)]


def test_posting(spark):
    rows = spark.createDataFrame([(1, 5, -1250, "EUR", D(2026, 1, 1)), (2, 5, -1000, "USD", D(2026, 1, 1)), (3, 5, -1000, "GBP", D(2026, 1, 1)), (4, 5, 0, "EUR", D(2026, 1, 1))], "id long, account_id long, raw_amount long, currency string, raw_date date")
    rates = spark.createDataFrame([(D(2026, 1, 1), "EUR", "USD", Decimal("1.25"))], "date date, base string, quote string, rate decimal(20,10)")
    rated = posting.with_rate(rows, rates)
    legs = {(r.entry_id, r.sort_order): (r.account_id, r.amount, r.amount_base) for r in posting.posting_legs(rated, F.lit(9)).collect()}
    assert legs == {(1, 0): (5, -1250, Decimal("-12.5000")), (1, 1): (9, 1250, Decimal("12.5000")), (2, 0): (5, -1000, Decimal("-8.0000")), (2, 1): (9, 800, Decimal("8.0000"))}
    assert {(r.id, r.reason) for r in posting.refusals(rated).collect()} == {(3, "no exchange rate"), (4, "zero amount")}


def test_posting_in_any_currency(spark):
    day = D(2026, 1, 1)
    rows = spark.createDataFrame([(1, 5, -1600, "JPY", day), (2, 5, 1500, "KWD", day), (3, 5, 150_000_00, "IDR", day), (4, 5, 100, "GBP", day), (5, 5, 100, "XXX", day), (6, 5, 100, "CHF", day), (7, 5, 10**18, "BIG", day)], "id long, account_id long, raw_amount long, currency string, raw_date date")
    stated = [("JPY", "160"), ("JPY", "160"), ("KWD", "0.3"), ("IDR", "150000"), ("GBP", "0.8"), ("GBP", "0.9"), ("CHF", "0"), ("BIG", "0.0000000001")]
    rates = spark.createDataFrame([(day, "EUR", q, Decimal(r)) for q, r in stated], "date date, base string, quote string, rate decimal(20,10)")
    currencies = spark.createDataFrame([("EUR", 2), ("JPY", 0), ("KWD", 3), ("IDR", 2), ("GBP", 2), ("CHF", 2), ("BIG", 2)], "code string, decimals int")
    rated = posting.with_rate(rows, rates, currencies=currencies)
    legs = {(r.entry_id, r.sort_order): (r.amount, r.amount_base) for r in posting.posting_legs(rated, F.lit(9)).collect()}
    assert legs == {(1, 0): (-1600, Decimal("-10.0000")), (1, 1): (1000, Decimal("10.0000")), (2, 0): (1500, Decimal("5.0000")), (2, 1): (-500, Decimal("-5.0000")), (3, 0): (15_000_000, Decimal("1.0000")), (3, 1): (-100, Decimal("-1.0000"))}
    assert {r.id: r.reason for r in posting.refusals(rated).collect()} == {4: "exchange rates differ", 5: "unknown currency", 6: "no exchange rate", 7: "amount out of range"}


def test_residual(spark):
    legs = spark.createDataFrame([(1, 0, Decimal("10.0000")), (1, 1, Decimal("-10.0040")), (2, 0, Decimal("10.0000")), (2, 1, Decimal("-9.0000"))], "entry_id long, sort_order int, amount_base decimal(18,4)")
    got = {(r.entry_id, r.sort_order): (r.amount_base, r.refused) for r in posting.absorb_residual(legs).collect()}
    assert got[(1, 1)] == (Decimal("-10.0000"), False) and got[(2, 0)] == (Decimal("9.0000"), True)


CARD = ["Statement", "14.03.26  15.03.26  JUMBO 4321 REF:1     8,50", "   Amsterdam", "14.03.26  14.03.26  CAFE     12,34", "14.03.26  16.03.26  CAFE     12,34", "CR", "15.03.26  15.03.26  KIOSK     4,10", "New Balance  37,28"]


def test_card_statement(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(CARD)], "file string, line_no int, text string")
    got = [(r.booked_date, r.processing_date, r.description, r.amount_minor) for r in layout.card_statement(lines).orderBy("row").collect()]
    assert got == [(D(2026, 3, 14), D(2026, 3, 15), "JUMBO 4321 REF:1 Amsterdam", -850), (D(2026, 3, 14), D(2026, 3, 14), "CAFE", -1234), (D(2026, 3, 14), D(2026, 3, 16), "CAFE", 1234), (D(2026, 3, 15), D(2026, 3, 15), "KIOSK", -410)]


def test_checking_statement(spark):
    head = "Date  Type  Description            Debit amount     Credit amount"
    text = [head, "30-12 ba  SHOP ONE" + " " * 20 + "10,00", "  extra", "02-01 tb  SALARY" + " " * 40 + "1.000,00"]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    got = [(r.booked_date, r.type_code, r.description, r.amount_minor) for r in layout.checking_statement(lines, F.lit(D(2025, 12, 20)), F.lit(D(2026, 1, 19))).orderBy("row").collect()]
    assert got == [(D(2025, 12, 30), "ba", "SHOP ONE extra", -1000), (D(2026, 1, 2), "tb", "SALARY", 100000)]


def test_sectioned_statement(spark):
    head = "Date          Description          Money out    Money in     Balance"
    row = lambda day, what, at, amount, balance: (f"{day}   {what}".ljust(at - 1) + amount).ljust(head.index("Balance")) + balance
    text = ["Current transactions", head, row("5 Sept 2025", "Shop", head.index("Money out") + 1, "€10.00", "€90.00"), "Report lost or stolen card", "noise", "Page 1 of 2", "Savings transactions", head, row("6 Sep 2025", "Interest", head.index("Money in") + 1, "€1.50", "€1,001.50")]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    got = [(r.section, r.booked_date, r.description, r.amount_minor, r.balance_minor) for r in layout.sectioned_statement(lines).orderBy("row").collect()]
    assert got == [("current", D(2025, 9, 5), "Shop", -1000, 9000), ("savings", D(2025, 9, 6), "Interest", 150, 100150)]


def test_ais(spark):
    payload = lambda status, amount, date='"2026-03-14"': f'{{"status": {status}, "bookingDate": {date}, "transactionAmount": {{"amount": "{amount}", "currency": "EUR"}}, "creditor": {{"name": "Shop"}}}}'
    rows = spark.createDataFrame([(1, 1, payload('"BOOK"', "-12.349")), (1, 2, payload('"PDNG"', "-12.34")), (1, 3, payload('"INFO"', "0.00")), (1, 4, payload("null", "1.00", "null"))], "account_id long, line_number int, payload string")
    got = {r.line_number: (r.amount_minor, r.pending, r.error) for r in ais.parse_payload(rows).collect()}
    assert got == {1: (-1234, False, None), 2: (-1234, True, None), 4: (100, False, "no booking date")}


def test_manual(spark):
    rows = spark.createDataFrame([(1, " x ", 1, "EUR", D(2026, 1, 1), 1), (1, "  ", 1, "EUR", D(2026, 1, 1), 2), (1, "y", 1, "EUR", None, 3)], "account_id long, description string, amount_minor long, currency string, booked_date date, line_number int")
    assert {r.line_number: (r.description, r.error) for r in manual.parse_entries(rows).collect()} == {1: ("x", None), 2: ("", "no description"), 3: ("y", "no date")}


def test_section_map(spark):
    rows = spark.createDataFrame([('{"Current": 1, "savings": 0, "moon": 3}',), ("no json",), ('{"A": 1, "a": 2}',)], "sections string")
    got = {(r.section, r.error) for r in layout.section_map(rows, ("current", "savings", "a")).collect()}
    assert got == {("current", None), ("savings", "not an account"), ("moon", "unknown section"), (None, "not a map of sections to ids"), ("a", "section given twice")}


def test_statement_identity_and_sabotage(spark):
    rows = spark.createDataFrame([(1, "m", 72135), (1, "m", -850), (1, "m", 7000), (1, "m", -17706)], "account_id long, period string, amount long")
    printed = spark.createDataFrame([(1, "m", "asset", 1000, 1000 + 72135 - 850 + 7000 - 17706)], "account_id long, period string, nature string, opening long, closing long")
    assert statements.identity_gaps(printed, rows).first().gap == 0
    assert statements.identity_gaps(printed, rows.where("amount <> -850")).first().gap == 850


def test_integrity(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, k string")
    assert checks.duplicates(rows, "k").count() == 2 and checks.duplicates(rows, "k", nulls_equal=False).count() == 1
    old = spark.createDataFrame([(1, "a", "{}"), (2, "b", "{}"), (3, "c", None)], "id long, raw_description string, raw_data string")
    new = spark.createDataFrame([(1, "a", "{}"), (3, "c", "{}")], "id long, raw_description string, raw_data string")
    assert {tuple(r) for r in checks.changed_raw(old, new).collect()} == {(2, "deleted"), (3, "altered")}


def test_import_is_idempotent(spark, tmp_path):
    store = importing.RecordStore(spark, str(tmp_path / "store"))
    rows = [(1, "Jumbo 4321", -850, "EUR", D(2026, 3, 14), None, None, False, 1), (1, "jumbo 4321 *", -850, "EUR", D(2026, 3, 14), None, None, False, 2), (2, "x", -1, "EUR", None, None, None, False, 3)]
    records = spark.createDataFrame(rows, importing.RECORD)
    first = importing.import_records(store, records)
    assert (first.record_count, first.created, first.duplicated, first.failed, first.status) == (3, 2, 0, 1, "partial")
    again = importing.import_records(store, records.limit(2))
    assert (again.created, again.duplicated, again.status) == (0, 2, "completed")
    assert store.read().count() == 2
    parsed = importing.identified(records.where("booked_date is not null"))
    assert importing.replay_difference(store, parsed).first().asDict() == {"only_parsed": 0, "only_stored": 0, "duplicates": 0}


def test_table_updates(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, name string, category_id long")
    changed = importing.patched(base, spark.createDataFrame([(2, None, 7)], "id long, name string, category_id long"))
    assert {tuple(r) for r in changed.collect()} == {(1, "a", 5), (2, "b", 7)}
    assert importing.without(changed, changed.where("id = 1")).count() == 1


def card_payments_in_turn(rows, lines):
    """A plain model: rows in order, each line taken once."""
    used, out = set(), {}
    for r in sorted(rows, key=lambda r: (r["line_number"], r["id"])):
        on_card, credit = r["account_id"] == r["card_id"], abs(r["amount"])
        near = lambda d: 0 <= (d - r["date"] if on_card else r["date"] - d).days <= 3  # noqa: B023, E731
        free = [x for x in lines if x["id"] not in used and not x["is_matched"] and near(x["date"])]
        made_up = [x for x in free if x["is_synthesized"] and x["account_id"] == r["account_id"] and x["amount"] == (credit if on_card else -credit)]
        spent = [x for x in free if on_card and not x["is_synthesized"] and x["is_expense"] and x["account_id"] == r["paying_id"] and x["amount"] == -credit]
        found, shape = (made_up, "match") if made_up else (spent, "rewrite")
        if len(found) > 1:
            out[r["id"]] = ("refused", None)
        elif found:
            used.add(found[0]["id"])
            out[r["id"]] = (shape, found[0]["id"])
        else:
            out[r["id"]] = ("build", None)
    return out


def test_card_payments_take_lines_in_turn(spark):
    rng, day = random.Random(3), dt.date(2024, 3, 1)
    rows, lines = [], []
    for i in range(160):
        card = rng.choice([10, 11])
        on_card = rng.random() < 0.7
        rows.append({"id": 1000 - i, "line_number": rng.randrange(90), "account_id": card if on_card else 1, "card_id": card, "paying_id": 1, "amount": rng.choice([100, 200, 300]) * (1 if on_card else -1), "currency": "EUR", "date": day + dt.timedelta(rng.randrange(40)), "refusal": None})
    for i in range(120):
        made_up = rng.random() < 0.5
        account = rng.choice([1, 10, 11]) if made_up else 1
        lines.append({"id": i, "entry_id": i, "account_id": account, "amount": rng.choice([100, 200, 300]) * (1 if account > 1 else -1), "date": day + dt.timedelta(rng.randrange(40)), "is_synthesized": made_up, "is_matched": rng.random() < 0.1, "is_expense": not made_up and rng.random() < 0.8})
    schema = "id long, line_number long, account_id long, card_id long, paying_id long, amount long, currency string, date date, refusal string"
    halves = "id long, entry_id long, account_id long, amount long, date date, is_synthesized boolean, is_matched boolean, is_expense boolean"
    got = cards.post_card_payments(spark.createDataFrame(rows, schema), spark.createDataFrame(lines, halves)).collect()
    assert {r.id: (r["shape"], r.line_id) for r in got} == card_payments_in_turn(rows, lines)
    assert {r["shape"] for r in got} == {"match", "rewrite", "build", "refused"}


def test_card_payment_candidates_are_shuffled_by_day(spark):
    rng = random.Random(13)
    sides = [[(i, rng.randrange(2), rng.choice((None, *range(1, 5))), rng.choice((None, *(D(2026, 2, 24) + dt.timedelta(k) for k in range(9))))) for i in range(start, start + 80)] for start in (0, 100)]
    card = spark.createDataFrame(sides[0], "id long, paying_id long, amount long, date date").coalesce(1)
    paying = spark.createDataFrame([(i, a, m and -m, d) for i, a, m, d in sides[1]], "id long, account_id long, amount long, date date").coalesce(1)
    pairs = posting.card_payment_candidates(card, paying)
    want = [(i, j) for i, a, m, d in sides[0] for j, b, n, e in sides[1] if a == b and m is not None and m == n and d and e and 0 <= (e - d).days <= 3]
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len(want) > 100
    # Pairs are many times the rows: they are made in as many tasks as are stated, however few tasks read the tables.
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_card_payment_candidates_come_in_tiles(spark):
    """Blocks of a key's ids meet, so that a page of a file of pairs has few lines; blocks of any size lose none."""
    day = D(2026, 3, 15)
    card = spark.createDataFrame([(k, 1, 500, day) for k in range(300)] + [(None, 1, 500, day)], "id long, paying_id long, amount long, date date")
    paying = spark.createDataFrame([(1000 + k, 1, -500, day + dt.timedelta(k % 2)) for k in range(1400)] + [(9, 1, -500, day + dt.timedelta(4))], "id long, account_id long, amount long, date date")
    rows = posting.card_payment_candidates(card, paying).collect()
    pairs = {tuple(r) for r in rows}
    assert len(rows) == len(pairs) == 301 * 1400 and pairs == {(c, 1000 + k) for c in (*range(300), None) for k in range(1400)}
    # A day's 700 paying lines come one after the other, with a block of card lines each.
    assert max(sum(len({r[k] for r in rows[at:at + 5000]}) for k in (0, 1)) for at in range(0, len(rows), 5000)) <= 512


def test_card_payment_roles_and_refusals(spark):
    accounts = spark.createDataFrame([
        (1, "asset", "EUR", True, None), (2, "liability", "EUR", True, 1), (3, "liability", "USD", True, 1), (4, "liability", "EUR", False, None), (5, "asset", "EUR", True, None), (6, "liability", "EUR", True, 5),
    ], "id long, account_nature string, currency string, is_active boolean, payment_from_account_id long")
    rows = [(1, 2, 500, None), (2, 1, -500, None), (3, 3, 500, None), (4, 5, -500, None), (5, 4, 500, 5), (6, 1, -500, 2), (7, 2, 0, None), (8, 2, 500, 6)]
    df = spark.createDataFrame([(i, i, a, m, "EUR", dt.date(2024, 1, 1), x) for i, a, m, x in rows], "id long, line_number long, account_id long, amount long, currency string, date date, explicit_id long")
    got = {r.id: (r.card_id, r.paying_id, r.refusal) for r in cards.with_roles(df, accounts).collect()}
    assert got[1] == (2, 1, None) and got[4] == (6, 5, None) and got[6] == (2, 1, None)
    # Two cards name account 1; the card's currency differs; account 4 is closed; nothing to pay; two liabilities.
    assert got[2][2] == "no card and paying account" and got[3][2] == "currency of an account differs" and got[5][2] == "no card and paying account"
    assert got[7][2] == "zero amount" and got[8][2] == "no card and paying account"


def test_import_posts_files_and_reports(spark):
    accounts = spark.createDataFrame([
        (1, "asset", "EUR", True, None, None), (2, "liability", "EUR", True, None, 1), (9, "equity", "EUR", True, "system_expense", None),
    ], "id long, account_nature string, currency string, is_active boolean, system_role string, payment_from_account_id long")
    day = dt.date(2024, 5, 6)
    rows = [
        (1, 1, 1, "GROCER", -100, "EUR", day, False), (2, 1, 2, "GROCER", -100, "EUR", day, False), (3, 1, 3, "OLD", -700, "EUR", day, False), (4, 1, None, "LOST", -5, "EUR", day, False),
        (5, 1, 2, "PAYMENT", 900, "EUR", day, True), (6, 1, 1, "ABROAD", -300, "USD", day, False), (7, 1, 1, "PAYMENT", -55, "EUR", day, None),
    ]
    records = spark.createDataFrame([(i, b, i, a, *rest) for i, b, a, *rest in rows], "id long, batch_id long, line_number long, account_id long, raw_description string, raw_amount long, currency string, raw_date date, is_card_payment boolean")
    stored = identity.with_fingerprint(identity.occurrence_index(records.where("id = 3")))
    rates = spark.createDataFrame([], "date date, base string, quote string, rate decimal(20,10)")
    halves = spark.createDataFrame([(70, 7, 2, 900, day, True, False, False)], "id long, entry_id long, account_id long, amount long, date date, is_synthesized boolean, is_matched boolean, is_expense boolean")
    filed = spark.createDataFrame([("GROCER", 44)], "raw_description string, category_id long")
    done = pipeline.Imported(pipeline.import_batch(records, stored, accounts, rates, halves, filed).judged.checkpoint())
    got = {r.id: (r.outcome, r["shape"], r.reason) for r in done.outcomes.collect()}
    assert got == {
        1: ("created", "posted", None), 2: ("created", "posted", None), 3: ("duplicated", None, None), 4: ("failed", None, pipeline.UNATTRIBUTED),
        5: ("created", "match", None), 6: ("failed", None, "no exchange rate"), 7: ("created", "posted", None),
    }
    lines = {(r.entry_id, r.sort_order): (r.account_id, r.amount, r.category_id) for r in done.lines.collect()}
    assert lines[1, 0] == (1, -100, 44) and lines[1, 1] == (9, 100, None) and lines[7, 0] == (1, -55, None) and {k for k, _ in lines} == {1, 2, 7}
    assert [(r.line_id, r.entry_id, r["shape"]) for r in done.touched.collect()] == [(70, 7, "match")]
    assert {r.id: (r.status, r.error_message) for r in done.rows.collect()}[6] == ("pending", "no exchange rate")
    report = done.report().first()
    assert (report.record_count, report.created, report.duplicated, report.failed, report.status) == (7, 4, 1, 2, "partial")
    # Whatever was stored is known the next time.
    again = pipeline.import_batch(records, done.rows.unionByName(stored, allowMissingColumns=True), accounts, rates, halves)
    assert {r.id: r.outcome for r in again.outcomes.collect()} == {i: "failed" if i == 4 else "duplicated" for i in range(1, 8)}


def test_import_ranks_its_records_once(spark):
    accounts = spark.createDataFrame([(1, "asset", "EUR", True, None, None), (2, "liability", "EUR", True, None, 1), (9, "equity", "EUR", True, "system_expense", None)],
                                     "id long, account_nature string, currency string, is_active boolean, system_role string, payment_from_account_id long")
    day = dt.date(2024, 5, 6)
    rows = [(1, 1, "SHOP", -100, False), (2, 1, "SHOP", -100, False), (3, 2, "PAYMENT", 900, True), (4, 1, "PAYMENT", -800, True), (5, 7, "PAYMENT", -7, True)]
    records = spark.createDataFrame([(i, 1, i, a, t, m, "EUR", day, c) for i, a, t, m, c in rows], "id long, batch_id long, line_number long, account_id long, raw_description string, raw_amount long, currency string, raw_date date, is_card_payment boolean")
    rates = spark.createDataFrame([], "date date, base string, quote string, rate decimal(20,10)")
    halves = spark.createDataFrame([], "id long, entry_id long, account_id long, amount long, date date, is_synthesized boolean, is_matched boolean, is_expense boolean")
    done = pipeline.import_batch(records, spark.createDataFrame([], "fingerprint string"), accounts, rates, halves)
    assert {r.id: (r["shape"], r.reason) for r in done.outcomes.collect()} == {1: ("posted", None), 2: ("posted", None), 3: ("build", None), 4: ("build", None), 5: (None, "no card and paying account")}
    lines = sorted((r.entry_id, r.sort_order, r.account_id, r.amount, r.amount_base, r.is_synthesized) for r in done.lines.collect())
    assert lines == [
        (1, 0, 1, -100, Decimal("-1.0000"), False), (1, 1, 9, 100, Decimal("1.0000"), False), (2, 0, 1, -100, Decimal("-1.0000"), False), (2, 1, 9, 100, Decimal("1.0000"), False),
        (3, 0, 2, 900, Decimal("9.0000"), False), (3, 1, 1, -900, Decimal("-9.0000"), True), (4, 0, 2, 800, Decimal("8.0000"), True), (4, 1, 1, -800, Decimal("-8.0000"), False),
    ]
    # Ranks were told when the records were read for the first time, and lines are one pass over what that gave.
    plan = done.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.count("Generate explode") == 1


def test_links_are_written_once(spark):
    lines = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 30, None), (4, 40, 77), (5, 50, None), (6, 60, None)], "id long, journal_entry_id long, transfer_match_id long")
    entries = spark.createDataFrame([(i * 10, False) for i in range(1, 7)], "id long, is_transfer boolean")
    links = [(1, 2), (3, 4), (5, 6), (5, 99), (3, 3), (1, 2)]
    df = spark.createDataFrame([(a, b, "manual", Decimal("1.00")) for a, b in links], "out_id long, in_id long, method string, confidence decimal(3,2)")
    got = pipeline.write_links(df, lines, entries)
    assert sorted((r.id, r.out_id, r.in_id) for r in got.matches.collect()) == [(1, 1, 2), (5, 5, 6)]
    assert {r.id: r.transfer_match_id for r in got.lines.collect()} == {1: 1, 2: 1, 3: None, 4: 77, 5: 5, 6: 5}
    assert {r.id for r in got.entries.where("is_transfer").collect()} == {10, 20, 40, 50, 60}
    both = pipeline.write_links(spark.createDataFrame([(1, 2, "m", Decimal("1.00")), (3, 2, "m", Decimal("1.00"))], df.schema), lines, entries)
    assert both.matches.isEmpty()


def test_batch_is_linked_and_reviewed(spark):
    day = dt.date(2024, 1, 1)
    legs = spark.createDataFrame([(1, 1, day, -100, "EUR"), (2, 2, day, 100, "EUR"), (3, 1, day, -500, "EUR"), (4, 2, day, 500, "EUR"), (5, 3, day, 500, "EUR"), (6, 1, day, -900, "EUR"), (7, 2, day, 900, "EUR")], "journal_line_id long, account_id long, booked_date date, amount long, currency string")
    lines = legs.select(F.col("journal_line_id").alias("id"), F.col("journal_line_id").alias("journal_entry_id"), F.lit(None).cast("long").alias("transfer_match_id"))
    entries = lines.select("id", F.lit(False).alias("is_transfer"))
    asked = spark.createDataFrame([(6,)], "out_id long")
    linked, queue = pipeline.link_batch(legs, lines, entries, open_reviews=asked)
    assert [(r.out_id, r.in_id) for r in linked.matches.collect()] == [(1, 2)] and [(r.out_id, r.candidates) for r in queue.collect()] == [(3, [4, 5])]
    decisions = spark.createDataFrame([(3, "confirm", 5)], "out_id long, action string, chosen long")
    after = pipeline.write_links(pipeline.confirmed_links(queue, decisions), linked.lines, linked.entries)
    assert {r.id: r.transfer_match_id for r in after.lines.collect()} == {1: 1, 2: 1, 3: 3, 4: None, 5: 3, 6: None, 7: None}


def test_replay_follows_rules_and_restores_the_rest(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", None), ("g", None), ("h", 6)], "fingerprint string, category_id long")
    now = spark.createDataFrame([("a", 1), ("b", None), ("c", 9), ("e", 9), ("f", 5), ("g", None), ("h", 6), ("h", 6)], "fingerprint string, category_id long")
    got = pipeline.replayed(now, before, now)
    assert {r.fingerprint: (r.state, r.category_id) for r in got.collect()} == {
        "a": ("same", 1), "b": ("restored", 2), "c": ("recategorised", 9), "d": ("missing", 4), "e": ("recategorised", 9), "f": ("extra", 5), "g": ("same", None), "h": ("repeated", 6)
    }
    assert not pipeline.may_replay(got).first().accepted and pipeline.may_replay(got.where("state not in ('missing', 'extra', 'repeated')")).first().accepted
    assert not pipeline.may_replay(got.where("state not in ('missing', 'extra')")).first().accepted


def test_categorise_by_joins(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(5, 9))) for _ in range(40)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))).upper()) for i in range(150)] + [(998, None), (999, "")]
    rows = spark.createDataFrame(texts, "id long, description string")
    rules = spark.createDataFrame([(500, words[0][1:], 1), (100, f" {words[1]} ", 2), (500, words[1][:2], 3), (1, "  ", 4)], "priority int, description_pattern string, category_id long")
    aliases = spark.createDataFrame([(words[k].upper(), None if k == 2 else k, Decimal("0.95")) for k in range(2, 8)], "raw_string string, category_id long, confidence decimal(3,2)")
    merchants = spark.createDataFrame([(words[k], k) for k in range(8, 14)] + [(words[k][:-1] + "z", k) for k in range(14, 22)] + [(words[9], None), ("zz", 5)], "name string, category_id long")
    small, joined = (sorted(tuple(r) for r in categorize.categorize(rows.fillna("", "description"), rules, aliases, merchants, most=most).collect()) for most in (100, 2))
    assert small == joined and {r[4] for r in small} == {1, 2, 3, 4, 7}
    assert categorize.categorize(rows, rules, aliases, merchants, most=2).count() == len(texts)


def test_deep_and_cyclic_categories(spark):
    # A chain of 70, a cycle of 5 with a tail, and a row whose parent is not listed.
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(200, 102), (300, 999)]
    categories = spark.createDataFrame([(i, p, f"c{i}", "expense") for i, p in rows], "id long, parent_id long, name string, kind string")
    paths = {r.id: r.path for r in analytics.ancestor_paths(categories).collect()}
    assert paths[69] == list(range(69, -1, -1)) and paths[102] == [102, 103, 104, 100, 101] and paths[200] == [200, 102, 103, 104, 100, 101]
    forest = {r.id: (r.depth, r.reason) for r in analytics.category_forest(categories).collect()}
    assert all(forest[i] == (i, None) for i in range(70)) and forest[101] == (None, "cycle") == forest[200] and forest[300] == (0, "not_listed")
    assert {r.id: r.n_descendants for r in analytics.descendants(categories.where("id < 70")).collect()}[0] == 69


def test_candidates_leave_out_what_cannot_be_a_pair(spark):
    day = dt.date(2024, 1, 1)
    legs = spark.createDataFrame([
        (1, 1, day, -100, "EUR", 5, None, False), (2, 2, day, 100, "EUR", 5, None, False), (3, 3, day, 100, "EUR", 6, 9, False), (4, 4, day, 100, "EUR", 7, None, True), (5, 5, day, 100, "EUR", 8, None, False),
    ], "journal_line_id long, account_id long, booked_date date, amount long, currency string, journal_entry_id long, transfer_match_id long, is_synthesized boolean")
    assert [(r.out_id, r.in_id) for r in transfers.candidates(legs).collect()] == [(1, 5)]
    assert transfers.swept(legs, day + dt.timedelta(91)).isEmpty() and transfers.swept(legs, day + dt.timedelta(90)).count() == 5


def test_money_of_other_exponents(spark):
    row = spark.sql("select 1234L as a, 1.25BD as rate").select(fm.converted(F.col("a"), F.col("rate"), 3).alias("three"), fm.converted(F.col("a"), F.col("rate"), 0).alias("none"), fm.converted(F.col("a"), F.col("rate")).alias("two")).first()
    assert row == (Decimal("0.9872"), Decimal("987.2000"), Decimal("9.8720"))
    sums = spark.createDataFrame([(1, "EUR", "EUR")], "a long, x string, y string").select(fm.same_currency(F.col("a") + 1, F.col("x"), F.col("y")).alias("s"))
    assert sums.first().s == 2
    with pytest.raises(Exception, match="different currencies"):
        spark.createDataFrame([(1, "EUR", "USD")], "a long, x string, y string").select(fm.same_currency(F.col("a") + 1, F.col("x"), F.col("y")).alias("s")).collect()


def test_lookups_creates_and_refused_deletes(spark):
    table = spark.createDataFrame([(1, "Food", "expense"), (5, "Rent", "expense")], "id long, name string, kind string")
    there, missing = importing.looked_up(table, spark.createDataFrame([(5,), (6,), (6,)], "id long"))
    assert [r.name for r in there.collect()] == ["Rent"] and [r.id for r in missing.collect()] == [6]
    after, refused = importing.created(table, spark.createDataFrame([("Zoo", "expense"), ("food ", "expense"), ("Art", "income"), ("art", "income")], "name string, kind string"), "name")
    assert {(r.id, r.name) for r in after.collect()} == {(1, "Food"), (5, "Rent"), (6, "Art"), (7, "Zoo")} and {r.name for r in refused.collect()} == {"food ", "art"}
    with pytest.raises(ValueError):
        importing.transactions_without(table, table)
    assert analytics.default_range(dt.date(2024, 3, 31)) == (dt.date(2024, 3, 1), dt.date(2024, 3, 31))


def as_lines(spark, text, file="a"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(text)], "file string, line_no int, text string")


def test_card_rows_over_several_lines(spark):
    lines = as_lines(spark, [
        "Nieuwe transacties voor: X", "14.03.26  15.03.26  HOTEL  1234,50", "  Room 12", "CR", "Pagina 2", "not of the row", "15.03.26  15.03.26  LOST", "Belangrijke informatie", "   7,00", "16.03.26  16.03.26  KIOSK  4,10",
        "Total  1,00", "New balance  3,00", "Page 3", "Payment Solutions BV",
    ])
    got = [(r.row, r.booked_date, r.description, r.amount_minor) for r in layout.card_statement(lines).orderBy("row").collect()]
    assert got == [(1, D(2026, 3, 14), "HOTEL Room 12", 123450), (3, D(2026, 3, 16), "KIOSK Total  1,00 Payment Solutions BV", -410)]
    assert [(r.row, r.line_no, r.reason) for r in layout.card_failures(lines).collect()] == [(2, 6, "no amount")]
    status = statements.batch_status(spark.createDataFrame([("a", "created"), ("a", "created")], "batch_id string, outcome string"), spark.createDataFrame([("a",), ("b",)], "batch_id string")).orderBy("batch_id").collect()
    assert [(r.batch_id, r.record_count, r.parse_failed, r.status) for r in status] == [("a", 2, 1, "completed"), ("b", 0, 1, "failed")]



def test_checking_fields_and_failures(spark):
    head = "Date  Type  Description            Debit amount     Credit amount"
    text = ["29-12 ba  EARLY" + " " * 20 + "3,00", head, "30-12 ba  SHOP" + " " * 20 + "10,00", "  extra words", "  Reference: AB 12", "  Reference: second", "  Creditor ID: NL1", "31-12 tb  NOTHING", head, "01-01 tb  PAY" + " " * 42 + "1,00"]
    lines = as_lines(spark, text)
    got = [(r.description, r.amount_minor, r.fields) for r in layout.checking_statement(lines, F.lit(D(2025, 12, 20)), F.lit(D(2026, 1, 19))).orderBy("row").collect()]
    assert got == [("SHOP extra words", -1000, {"Reference": "AB 12", "Creditor ID": "NL1"}), ("PAY", 100, {})]
    assert [(r.row, r.reason) for r in layout.checking_failures(lines).orderBy("row").collect()] == [(1, "no heading of amounts"), (3, "no amount")]


def test_sections_accounts_and_furniture(spark):
    head = "Date          Description          Money out    Money in     Balance"
    row = lambda day, what, at, amount, balance: (f"{day}   {what}".ljust(at) + amount).ljust(head.index("Balance")) + balance
    text = ["My Bank statement", "Current transactions", head, row("5 Sept 2025", "Shop", head.index("Money out"), "€10.00", "€90.00"), "   To: Shop BV", "   Reference: r1", "My Bank statement", "6 Sep 2025    No amount", "Report lost or stolen", "x", "page 1 of 1", "Vault transactions", row("7 Sep 2025", "In", head.index("Money in"), "€1.00", "€1.00")]
    lines = as_lines(spark, text)
    mapping = spark.createDataFrame([("current", 3, None), ("vault", 4, "unknown section")], "section string, account_id long, error string")
    got = layout.with_section_accounts(layout.sectioned_statement(lines, r"^My Bank"), mapping).orderBy("row").collect()
    assert [(r.section, r.amount_minor, r.to, r.reference, r.account_id) for r in got] == [("current", -1000, "Shop BV", "r1", 3), ("vault", 100, None, None, None)]
    assert [(r.row, r.reason) for r in layout.sectioned_failures(lines, r"^My Bank").collect()] == [(2, "no amount in a money column")]
    assert layout.furniture_dropped(lines, r"^My Bank").first().dropped == 5


def test_statement_headers(spark):
    got = layout.statement_header(as_lines(spark, ["IBAN / account number", "NL91 ABNA 0417 1643 00", "From (date)", "01-02-2026", "To (date)", "28-02-2026", "Total amount debited  Total amount credited", " EUR 1.234,50   EUR 7,00", "Generated on the 3rd of March"])).first()
    assert (got.period_from, got.period_to, got.ibans, got.debit_total, got.credit_total, got.generated) == (D(2026, 2, 1), D(2026, 2, 28), ["NL91ABNA0417164300"], 123450, 700, "3rd of March")
    empty = layout.statement_header(as_lines(spark, ["nothing"])).first()
    assert (empty.period_from, empty.ibans, empty.debit_total, empty.generated) == (None, [], None, None)


@pytest.fixture()
def imports(spark, tmp_path):
    """A store and what imports into it need."""
    accounts = spark.createDataFrame([
        (1, "asset", "EUR", True, None, None), (2, "liability", "EUR", True, None, 1), (3, "asset", "EUR", True, None, None), (9, "equity", "EUR", True, "system_expense", None),
    ], "id long, account_nature string, currency string, is_active boolean, system_role string, payment_from_account_id long")
    rates = spark.createDataFrame([], "date date, base string, quote string, rate decimal(20,10)")
    store = LedgerStore(spark, str(tmp_path / "ledger"))

    def load(batch, rows):
        records = spark.createDataFrame([(i, batch, i, a, t, m, "EUR", d, c) for i, a, t, m, d, c in rows], "id long, batch_id long, line_number long, account_id long, raw_description string, raw_amount long, currency string, raw_date date, is_card_payment boolean")
        return pipeline.import_into(store, str(batch), records, accounts, rates, spark.createDataFrame([("GROCER", 44)], "raw_description string, category_id long"))

    def replay(batch, parsed, **filed):
        records = spark.createDataFrame([(900 + i, batch, i, a, t, m, "EUR", d, c) for i, a, t, m, d, c in parsed], "id long, batch_id long, line_number long, account_id long, raw_description string, raw_amount long, currency string, raw_date date, is_card_payment boolean")
        return pipeline.replay_into(store, batch, records, accounts, rates, spark.createDataFrame(list(filed.items()), "raw_description string, category_id long"))

    return store, load, replay


DAY = dt.date(2024, 5, 6)


def test_whole_import_and_replay(spark, imports):
    store, load, replay = imports
    card = [(1, 2, "GROCER", -100, DAY, False), (2, 2, "GROCER", -100, DAY, False), (3, 2, "PAYMENT", 900, DAY, True), (4, None, "LOST", -5, DAY, False)]
    assert load(1, card) == 1
    lines = {r.id: r for r in store.read("lines").collect()}
    assert {(r.entry_id, r.account_id, r.amount, r.category_id, r.is_synthesized) for r in lines.values()} == {
        (1, 2, -100, 44, False), (1, 9, 100, None, False), (2, 2, -100, 44, False), (2, 9, 100, None, False), (3, 2, 900, None, False), (3, 1, -900, None, True),
    }
    # The other statement brings the other half, and a transfer between two accounts.
    load(2, [(5, 1, "CARD", -900, DAY + dt.timedelta(1), True), (6, 1, "MOVE", -5000, DAY, False), (7, 3, "MOVE", 5000, DAY, False)])
    rows = {r.id: r for r in store.read("rows").collect()}
    assert rows[5].entry_id == 3 and {i: r.status for i, r in rows.items()} == dict.fromkeys((1, 2, 3, 5, 6, 7), "posted")
    matches = {(r.out_id, r.in_id, r.method, r.confidence) for r in store.read("matches").collect()}
    assert matches == {(7, 6, "auto_card_payment", Decimal("0.95")), (12, 14, "auto_amount_date", Decimal("0.95"))}
    assert {r.id for r in store.read("lines").where("transfer_match_id is not null").collect()} == {6, 7, 12, 14}
    assert {r.id for r in store.read("entries").where("is_transfer").collect()} == {3, 6, 7}
    assert [(r.id, r.created, r.duplicated, r.failed, r.status) for r in store.read("batches").orderBy("id").collect()] == [("1", 3, 0, 1, "partial"), ("2", 3, 0, 0, "completed")]

    # The first batch again, from its input, whose records have other ids than the rows: nothing changes.
    state = lambda: {t: sorted(map(str, store.read(t).collect())) for t in ("rows", "entries", "lines", "matches", "reviews")}
    before = state()
    assert replay(1, card[:3], GROCER=44) is None and state() == before and store.version().number == 2
    # A rule that is sure wins, also over what was set by hand; where none is, the category before stays.
    store.commit({"lines": Change(store.read("lines").where("id in (2, 4)").withColumn("category_id", F.lit(7).cast("long")))})
    assert replay(1, [(1, *card[0][1:]), (2, *card[1][1:]), card[2]], GROCER=55) == 4
    assert {r.category_id for r in store.read("lines").where("id in (2, 4)").collect()} == {55} and store.read("matches").count() == 2
    # Input that isn't what is stored.
    for parsed, differences in ((card[1:3], {"extra": 0, "missing": 1, "repeated": 0}), ([*card[:3], (8, 2, "NEW", -1, DAY, False)], {"extra": 1, "missing": 0, "repeated": 0})):
        with pytest.raises(pipeline.ReplayRefused) as refused:
            replay(1, parsed)
        assert refused.value.differences == differences and store.version().number == 4
    before = state()
    store.compact()
    assert all(len(parts) <= 1 for parts in store.version().parts.values()) and state() == before


def test_expense_is_rewritten_as_a_card_payment(spark, imports):
    store, load, _ = imports
    load(1, [(1, 1, "CARD CO", -700, DAY, False)])
    load(2, [(2, 2, "PAYMENT", 700, DAY, True)])
    assert {(r.id, r.entry_id, r.account_id, r.amount, r.transfer_match_id) for r in store.read("lines").collect()} == {(2, 1, 1, -700, 2), (-2, 1, 2, 700, 2)}
    assert [(r.out_id, r.in_id) for r in store.read("matches").collect()] == [(2, -2)]
    assert store.read("entries").select("is_transfer").collect() == [(True,)]


def test_a_writer_that_dies_leaves_nothing(spark, imports, monkeypatch):
    store, _, _ = imports
    entry = lambda i, a: {"entries": Change(spark.createDataFrame([(i, DAY, "x", False)], store.schemas["entries"])), "lines": Change(spark.createDataFrame([(2 * i + k, i, k, 1, s * a, "EUR", Decimal(s * a), None, False, None) for k, s in ((0, 1), (1, -1))], store.schemas["lines"]))}
    store.commit(entry(1, 5))
    real = LedgerStore.stage
    for table in ("entries", "lines", "version"):
        def stage(self, name, *args, table=table):
            written = real(self, name, *args)
            if name == table:
                raise RuntimeError("killed")
            return written

        def publish(self, *_):
            raise RuntimeError("killed")

        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(LedgerStore, *(("_publish", publish) if table == "version" else ("stage", stage)))
            store.commit(entry(2, 7))
        assert store.version().number == 1 and store.read("lines").count() == 2 and store.read("entries").count() == 1
    store.commit(entry(3, 7))
    assert {r.id for r in store.read("entries").collect()} == {1, 3}


def test_the_gate_and_the_race(spark, imports):
    store, _, _ = imports
    schema = store.schemas
    entries = lambda *ids: Change(spark.createDataFrame([(i, DAY, "x", False) for i in ids], schema["entries"]))
    line = lambda i, e, base: (i, e, 0, 1, 1, "EUR", None if base is None else Decimal(base), None, False, None)
    lines = lambda *rows: Change(spark.createDataFrame([line(*r) for r in rows], schema["lines"]))
    match = lambda *rows: Change(spark.createDataFrame([(i, a, b, "m", Decimal("1.00")) for i, (a, b) in enumerate(rows)], schema["matches"]))
    for changes, broken in (
        ({"entries": entries(1), "lines": lines((1, 1, "1.00"), (2, 1, "-1.01"))}, {"unbalanced": 1}),
        ({"entries": entries(1, 2), "lines": lines((1, 1, "0.00"))}, {"few_lines": 2}),
        ({"lines": lines((1, 7, "1.00"), (2, 7, "-1.00"))}, {"no_entry": 1}),
        ({"entries": entries(1), "lines": lines((1, 1, None), (2, 1, "0.00"))}, {"no_base_amount": 1}),
        ({"matches": match((1, 1))}, {"self_match": 1, "matched_twice": 1}),
        ({"matches": match((1, 2), (2, 3))}, {"matched_twice": 1}),
    ):
        with pytest.raises(Refused) as refused:
            store.commit(changes)
        assert refused.value.broken == broken and store.version().number == 0
    base = store.version()
    store.commit({"entries": entries(1), "lines": lines((1, 1, "1.00"), (2, 1, "-1.004"))}, base)
    with pytest.raises(Conflict):
        store.commit({"entries": entries(2), "lines": lines((3, 2, "1.00"), (4, 2, "-1.00"))}, base)
    # A line that goes leaves its entry out of balance, unless another comes.
    gone = spark.createDataFrame([(2,)], "id long")
    with pytest.raises(Refused):
        store.commit({"lines": Change(spark.createDataFrame([], schema["lines"]), gone)})
    store.commit({"lines": Change(spark.createDataFrame([line(5, 1, "-1.00")], schema["lines"]), gone)})
    assert {r.id for r in store.read("lines").collect()} == {1, 5} and store.read("matches").isEmpty()


def test_archive_round_trip(spark):
    contents = [("a", b"plain"), ("b", b""), ("c", bytes(range(256)) * 5000), ("d", None)]
    files = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in contents], "path string, content binary").repartition(2)
    archive = importing.archived(files)
    assert sorted(archive.collect()) == sorted(importing.archived(files.repartition(1)).collect())
    back = {r.path: (r.content, r.error) for r in importing.restored(archive).collect()}
    assert {p: None if c is None else bytes(c) for p, (c, _) in back.items()} == dict(contents) and {p: e for p, (_, e) in back.items() if e} == {"d": importing.NO_PAYLOAD}
    good = {r.path: r for r in archive.collect()}
    broken = spark.createDataFrame([("1", good["a"].checksum, "**"), ("2", good["a"].checksum, "cGxhaW4="), ("3", good["b"].checksum, good["a"].payload), ("4", good["c"].checksum, good["c"].payload[:400])], importing.ARCHIVE)
    assert {r.path: r.error for r in importing.restored(broken).collect()} == {"1": importing.NOT_BASE64, "2": importing.NOT_GZIP, "3": importing.NOT_THE_CONTENT, "4": importing.NOT_GZIP}


def test_archive_handles_few_bytes_at_once(spark):
    import pyarrow as pa

    sizes = [0, 9, None, 1, 40, 3, 3, 3, 3, 0, 0, 50, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(sizes))]), pa.array([None if n is None else bytes(n) for n in sizes], pa.binary())], ["path", "content"])
    slices = list(importing._slices([batch, batch.slice(0, 0), batch], 1, 10))
    assert [p for s in slices for p in s.column(0).to_pylist()] == 2 * [str(i) for i in range(len(sizes))]
    # No slice has more than the limit beside its first row.
    assert max(sum(len(c or b"") for c in s.column(1).to_pylist()[1:]) for s in slices) <= 10 and len(slices) > 8
    # Contents of several slices come back whole.
    rows = spark.range(60).coalesce(1).select(F.col("id").cast("string").alias("path"), F.expr("cast(repeat(id, 200000) as binary)").alias("content"))
    back = importing.restored(importing.archived(rows))
    assert back.where("error is null").agg(F.sum(F.length("content"))).first()[0] == rows.agg(F.sum(F.length("content"))).first()[0]


def test_json_scalars(spark):
    texts = ['{"a": 1, "b": "x", "c": null, "d": true, "e": [1], "f": {"g": 2}, "h": 1.50}', "{}", "[1]", None, "no json"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.m for r in df.select("id", ais.scalars(F.col("t")).alias("m")).collect()}
    assert {**got[0], "h": float(got[0]["h"])} == {"a": "1", "b": "x", "c": None, "d": "true", "h": 1.5}
    assert got[1] == {} and not got[2] and got[3] is None and not got[4]


def test_running_balance_over_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(a, n, rng.choice([None, rng.randint(-50, 50)])) for a in (1, 2, None) for n in [None, *rng.sample(range(-40, 400), 60)]]
    df = spark.createDataFrame(rows, "account_id long, line_number long, amount long").repartition(3)
    want = {}
    for a in (1, 2, None):
        total = None
        for numbered, n, x in sorted(((n is not None, n or 0, x) for b, n, x in rows if b == a), key=lambda r: r[:2]):
            total = total if x is None else (total or 0) + x
            want[a, n if numbered else None] = total
    for width in (7, 65_536):
        monkeypatch.setattr(statements, "BALANCE_BLOCK", width)
        assert {(r.account_id, r.line_number): r.balance for r in statements.running_balance(df).collect()} == want


def test_rows_of_one_amount_meet_those_of_a_few_days(spark):
    day = dt.date(2024, 1, 1)
    row = lambda i, d: (i, 1, 500, day + dt.timedelta(d), "EUR")
    schema = "id long, account_id long, amount_minor long, booked_date date, currency string"
    new, stored = [row(i, 3 * i) for i in range(60)], [row(1000 + i, i) for i in range(200)]
    pairs = identity.tier2_candidates(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema))
    assert {(r.new_id, r.stored_id) for r in pairs.collect()} == {(a, s) for a, *_, d, _ in new for s, *_, e, _ in stored if -1 <= (e - d).days <= 3}
    assert "_span" in pairs._jdf.queryExecution().toString()


def test_a_stored_row_is_taken_once(spark):
    day = dt.date(2024, 1, 1)
    schema = "id long, account_id long, amount_minor long, booked_date date, currency string, description string, provider_txn_id string, merchant_alias_id long, pending boolean, fingerprint string"
    row = lambda i, text, txn="", d=0, fp="": (i, 1, 500, day + dt.timedelta(d), "EUR", text, txn, 7, True, fp or f"f{i}")
    stored = spark.createDataFrame([row(100, "jumbo"), row(101, "elsewhere", "T1")], schema)
    new = spark.createDataFrame([row(1, "jumbo"), row(2, "jumbo"), row(3, "other", "T1"), row(4, "far off", d=60, fp="f100"), row(5, "new", d=90)], schema)
    got = {r.id: (r.tier, r.needs_review, r.stored_id) for r in identity.resolve(new, stored).collect()}
    assert got[1][0] == 2 and got[1][2] == 100 and got[3][0] == 1 and got[4][0] == 3 and got[5][0] == 0
    assert sum(stored_id == 100 for _, _, stored_id in got.values()) == 1


def test_rows_are_stamped_when_touched(spark):
    then = dt.datetime(2020, 1, 1)
    old = spark.createDataFrame([(1, "a", then), (2, "b", then)], "id long, name string, updated_at timestamp")
    new = spark.createDataFrame([(1, "a", None), (2, "c", None), (3, None, None)], "id long, name string, updated_at timestamp")
    at = {r.id: r.updated_at for r in checks.touched(old, new, "name").collect()}
    assert at[1] == then and at[2] > then and at[3] > then


def test_closed_lists(spark):
    accounts = spark.createDataFrame([(1, "checking", "asset"), (2, "purse", None)], "id long, account_type string, account_nature string")
    categories = spark.createDataFrame([(1, "expense"), (2, "fun")], "id long, kind string")
    rows = spark.createDataFrame([(1, "posted"), (2, "lost")], "id long, status string")
    batches = spark.createDataFrame([("x", "manual"), ("y", "fax")], "id string, provider string")
    got = {(r.what, r.id, r.value) for r in checks.outside_vocabulary(accounts, categories, rows, batches).collect()}
    assert got == {("account_type", "2", "purse"), ("account_nature", "2", None), ("kind", "2", "fun"), ("status", "2", "lost"), ("provider", "y", "fax")}


def test_budget_in_one_currency(spark):
    row = spark.createDataFrame([(150, 100, "EUR", "EUR")], "s long, l long, a string, b string")
    columns = lambda df: df.select(*[c.alias(n) for c, n in zip(analytics.budget_check(F.col("s"), F.col("l"), F.col("a"), F.col("b")), ("left", "over", "used"), strict=True)])
    assert tuple(columns(row).first()) == (-50, True, 150)
    with pytest.raises(Exception, match="different currencies"):
        columns(row.withColumn("b", F.lit("USD"))).collect()


def test_creates_and_their_refusals(spark):
    categories = spark.createDataFrame([(1, None, "Home", "expense"), (2, 1, "Rent", "expense")], "id long, parent_id long, name string, kind string")
    rows = spark.createDataFrame([(1, "Gas", "expense"), (1, "Rent", "expense"), (None, "Home", "income"), (9, "Lost", "expense"), (None, "Fun", "hobby"), (2, "Rent", "expense"), (1, "Gas", "income")], "parent_id long, name string, kind string")
    table, refused = importing.with_categories(categories, rows)
    assert sorted((r.parent_id or 0, r.name, r.kind) for r in table.where("id > 2").collect()) == [(1, "Gas", "expense"), (2, "Rent", "expense")] and table.select("id").distinct().count() == 4
    assert sorted((r.name, r.reason) for r in refused.collect()) == [("Fun", "unknown kind"), ("Gas", "name is taken"), ("Home", "name is taken"), ("Lost", "no such parent"), ("Rent", "name is taken")]
    merchants = spark.createDataFrame([(4, "jumbo", 2)], "id long, name string, category_id long")
    table, refused = importing.with_merchants(merchants, spark.createDataFrame([("jumbo", 1), ("aldi", None), ("lidl", 77)], "name string, category_id long"), categories)
    assert {(r.name, r.category_id) for r in table.collect()} == {("jumbo", 2), ("aldi", None)} and {(r.name, r.reason) for r in refused.collect()} == {("jumbo", "name is taken"), ("lidl", "no such category")}
    accounts = spark.createDataFrame([(7, "a", "checking", "asset", "EUR")], "id long, name string, account_type string, account_nature string, currency string")
    new = [("a", "savings", "asset", "EUR"), ("b", "purse", "asset", "EUR"), ("c", "cash", "money", "EUR"), ("d", "cash", "asset", "XXX"), ("e", "cash", "asset", None)]
    table, refused = importing.with_accounts(accounts, spark.createDataFrame(new, "name string, account_type string, account_nature string, currency string"), spark.createDataFrame([("EUR",)], "code string"))
    assert [(r.name, r.account_type) for r in table.orderBy("id").collect()] == [("a", "checking"), ("a", "savings")]
    assert {r.name: r.reason for r in refused.collect()} == {"b": "unknown account type", "c": "unknown account nature", "d": "unknown currency", "e": "unknown currency"}


def test_pairs_against_a_plain_model(spark):
    """Close amounts in a few groups: counts, items, lists and skips equal those of all pairs, with null currencies and shared entries."""
    rng = random.Random(11)
    rows = [
        (i, rng.choice((1, 2, 3, None)), D(2026, 1, 1 + rng.randint(0, 8)), rng.choice((-1, 1)) * (480 + rng.randint(0, 90)), rng.choice(("EUR", "EUR", "USD", "GBP", None)), i // 3 if i % 2 else 1000 + i)
        for i in range(400)
    ]
    legs = spark.createDataFrame(rows, "journal_line_id long, account_id long, booked_date date, amount long, currency string, journal_entry_id long")
    want = {}
    for o in rows:
        for i in rows:
            same = o[4] is not None and o[4] == i[4]
            if o[3] < 0 < i[3] and None not in (o[1], i[1]) and o[1] != i[1] and o[5] != i[5] and -1 <= (i[2] - o[2]).days <= 3 and abs(o[3] + i[3]) <= (1 if same else 50):
                want[o[0], i[0]] = same and o[3] + i[3] == 0 and o[2] == i[2]
    outs = {o: sorted(i for p, i in want if p == o) for o, _ in want}
    assert {(r.out_id, r.in_id): r.exact and r.same_day for r in transfers.candidates(legs).collect()} == want
    assert {r.out_id: r.n_candidates for r in transfers.leg_outcomes(legs).collect()} == {o: len(x) for o, x in outs.items()}
    assert transfers.leg_outcomes(legs).exceptAll(transfers.outcomes(transfers.candidates(legs))).count() == 0
    assert {r.out_id: r.in_ids for r in transfers.listed(legs).collect()} == outs
    reviews = transfers.leg_reviews(legs)
    assert {tuple(map(str, r)) for r in reviews.collect()} == {tuple(map(str, r)) for r in transfers.reviews(transfers.candidates(legs)).collect()}
    items = {tuple(r) for r in transfers.leg_review_items(legs).collect()}
    assert items == {tuple(r) for r in transfers.review_items(reviews, legs).collect()} and len(items) > 500
    skipped = spark.createDataFrame([p for k, p in enumerate(want) if k % 3 == 0] + [(10**6, 1)], "out_id long, in_id long")
    assert {(r.out_id, r.in_id) for r in transfers.candidates(legs, skipped).collect()} == {p for k, p in enumerate(want) if k % 3}
    fresh = {(r.out_id, r.in_id) for r in transfers.leg_review_items(legs, skipped).collect()}
    assert fresh == {(r.out_id, r.in_id) for r in transfers.new_skips(reviews, skipped).collect()}
    assert {(r.out_id, r.in_id) for r in transfers.sole_links(legs).collect()} == {(o, x[0]) for o, x in outs.items() if len(x) == 1 and want[o, x[0]]}


def test_pairs_are_not_shuffled(spark):
    """A pair a leg is within reach of never passes through a shuffle: only legs do."""
    legs = _legs(spark, [(1, 1, D(2026, 3, 15), -5000, "EUR"), (2, 2, D(2026, 3, 15), 5000, "EUR")])
    for df in (transfers.leg_review_items(legs), transfers.leg_reviews(legs), transfers.candidates(legs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.index("MapInArrow") < plan.index("Repartition")
    assert "Join" not in transfers.leg_outcomes(legs)._jdf.queryExecution().optimizedPlan().toString()


def _crowd(spark, amounts, ins):
    """One day's legs in the order of a lottery: 40 outbound ones of some amounts, and as many inbound ones of each as said, of an account each."""
    rows = [(1 - 2 * (k < 40)) * amounts[k % len(amounts)] for k in range(40 + ins * len(amounts))]
    rows = [(k, k, D(2026, 3, 15), amount, "EUR") for k, amount in enumerate(rows)]
    random.Random(3).shuffle(rows)
    return _legs(spark, rows)


def test_equal_lists_are_neighbours(spark):
    """Outbound legs of one amount have the same candidates: their lists follow each other, so that a file can hold them once."""
    lists = [r.in_ids for r in transfers.listed(_crowd(spark, [800, 810, 820, 830], 50)).collect()]
    assert len(lists) == 40 and sum(a != b for a, b in zip(lists, lists[1:])) == 3


def _most_apart(rows):
    """The most inbound legs that 5,000 rows in turn have."""
    return max(len({r.in_id for r in rows[k:k + 5000]}) for k in range(0, len(rows), 5000))


def test_items_come_in_tiles(spark):
    """A page of a file of them has few inbound legs, however many an outbound leg has."""
    items = transfers.leg_review_items(_crowd(spark, [800], 2000)).collect()
    assert len(items) == 80_000 and _most_apart(items) <= 512
    assert {(r.out_id, r.position) for r in items} == {(o, k) for o in range(40) for k in range(2000)}


def test_scored_pairs_come_in_tiles(spark):
    pairs = transfers.scored(transfers.candidates(_crowd(spark, [800], 2000))).collect()
    assert len({(r.out_id, r.in_id) for r in pairs}) == len(pairs) == 80_000 and _most_apart(pairs) <= 512
    assert {r.confidence for r in pairs} == {Decimal("0.95")}


def test_tiles_are_cut_from_ranges(monkeypatch):
    """Small tiles over two groups and three currencies: the pairs are those that are listed leg by leg, tile after tile."""
    rng = np.random.default_rng(5)
    n = 300
    gap = [None if k % 2 else int(g) for k, g in enumerate(rng.integers(-1, 4, n))]
    legs = pa.table({
        "bucket": np.arange(n) // 200, "day": np.zeros(n, np.int64), "gap": pa.array(gap, pa.int32()), "id": rng.permutation(n), "account": rng.integers(0, 20, n),
        "place": rng.integers(100, 200, n).astype(np.int32), "currency": pa.array([(None, "EUR", "USD")[k] for k in rng.integers(0, 3, n)]),
    })
    monkeypatch.setattr(pairing, "TILE", 7)
    monkeypatch.setattr(pairing, "PAIRS", 900)
    g = pairing._Groups(legs)
    listed, tiled = ([p for p in g.pairs(np.arange(g.n), ordered=ordered)] for ordered in (True, False))
    told = lambda ps: sorted((int(o), int(i), bool(e)) for p in ps for o, i, e in zip(p["o"], p["i"], p["exact"]))
    assert told(listed) == told(tiled) and len(tiled) > 3 and sum(len(p["o"]) for p in tiled) == g.count().sum() > 2000
    assert all((np.diff(p["i"] // 7 * g.n + p["o"]) >= 0).all() for p in tiled)


def _maps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def _events(spark, tmp_path):
    """The folder of a table of 30 outbound and 30 inbound legs of one amount and day."""
    spark.createDataFrame([(k, dt.datetime(2024, 1, 1), k, "error" if k % 2 else "view", 8.0) for k in range(60)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_skips_of_whole_legs_are_rows(spark, tmp_path):
    """What is skipped with a leg is told by a row for the leg: pairs aren't made once to be listed and again to be left out."""
    legs = _crowd(spark, [800, 810], 30)
    outs, barred = set(range(40)), spark.createDataFrame([(3,), (4,), (4,), (50,), (99,), (10**6,)], "id long")
    every = {(r.out_id, r.in_id) for r in transfers.candidates(legs).collect()}
    left = {(o, i) for o, i in every if not {o, i} & {3, 4, 50, 99}}
    stored = spark.createDataFrame([(5, 60), (5, 61), (3, 70)], "out_id long, in_id long")
    assert {(r.out_id, r.in_id) for r in transfers.candidates(legs, barred=barred).collect()} == left and len(left) < len(every)
    assert {(r.out_id, r.in_id) for r in transfers.candidates(legs, stored, barred).collect()} == left - {(5, 60), (5, 61)}
    assert {o for o, _ in left} == outs - {3, 4}
    query = queries.QUERIES["anti_skip"](spark, _events(spark, tmp_path))
    assert {(r.out_id, r.in_id) for r in query.collect()} == {(o, i) for o in range(1, 60, 2) for i in range(0, 60, 2) if o % 3}
    assert _maps(query) == 1


def test_skipped_legs_count_for_positions(spark, tmp_path):
    """Pairs that are skipped already are no items, and the others keep their places; two candidates stay two if one is skipped."""
    legs = _legs(spark, [(k, k, D(2026, 3, 15), -500 if k == 1 else 500, "EUR") for k in (1, 2, 3)])
    items = transfers.leg_review_items(legs, barred=spark.createDataFrame([(2,)], "id long")).collect()
    assert [(r.out_id, r.position, r.in_id) for r in items] == [(1, 1, 3)]
    query = queries.QUERIES["skip_pairs"](spark, _events(spark, tmp_path))
    assert {(r.out_id, r.in_id) for r in query.collect()} == {(o, i) for o in range(1, 60, 2) for i in range(0, 60, 2) if i % 3}
    assert _maps(query) == 1


def test_base_that_rounds_to_nothing(spark):
    """Such an amount can be converted, so fx_exponents has no refusal for it; it still isn't posted."""
    day = D(2026, 1, 1)
    rows = spark.createDataFrame([(1, 5, -400, "IDR", day), (2, 5, 100, "XXX", day)], "id long, account_id long, raw_amount long, currency string, raw_date date")
    rates = spark.createDataFrame([(day, "EUR", "IDR", Decimal("150000"))], "date date, base string, quote string, rate decimal(20,10)")
    currencies = spark.createDataFrame([("EUR", 2), ("IDR", 2)], "code string, decimals int")
    got = {r.id: (r.unconvertible, r.refusal, r.amount_base) for r in posting.based(posting.with_rate(rows, rates, currencies=currencies)).collect()}
    assert got == {1: (None, "zero amount", Decimal("0.0000")), 2: ("unknown currency", "unknown currency", None)}


def test_statement_lines_in_blocks(spark, monkeypatch):
    """Rows, headings and sections reach over blocks of lines; only blocks are windowed, never a whole file."""
    texts = ["Date Type  Debit amount       Credit amount", "01-02 ba  SHOP 1        12,50", "   more", "   Reference: K1", "02-02 tb  SHOP 2                          3,00", "   Page 1"]
    lines = spark.createDataFrame([(f, k + 1, t) for f in ("a", "b") for k, t in enumerate(texts * 3)], "file string, line_no int, text string")
    card = spark.createDataFrame([("c", k, t) for k, t in enumerate(["head", "01.02.24  01.02.24  SHOP 1   12,50", "more", "   CR", "02.02.24  02.02.24  SHOP 2", "03.02.24  03.02.24  SHOP 3   1,00"])], "file string, line_no int, text string")

    def read():
        checking = layout.checking_statement(lines, F.lit(D(2024, 1, 1)), F.lit(D(2024, 12, 31)))
        return [sorted(map(str, df.collect())) for df in (checking, layout.card_statement(card), layout.card_failures(card), layout.furniture_dropped(lines))]

    whole = read()
    assert [len(x) for x in whole] == [12, 2, 1, 2]
    monkeypatch.setattr(layout, "LINE_BLOCK", 2)
    assert read() == whole
