"""Text expressions: normalisers, fingerprints, similarities, redaction and number rewriting.

Spaces are Unicode's ((?U)), as statements use no-break spaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that banks put into descriptions. They are not anchored at the end.
MARKER_PATTERN = r"\s*(?:#?\s*REF\s*:\s*\S+|#?\s*REF\s+\S+|\*\s*REF\s*\S+|KAASACHTELNR\s*:?\s*\S+|CARD\s*:\s*\S+|MNDT\s*\d+|\*+|#+)\s*"
# Account numbers with spaces between groups and without, masked cards, wordings of a card's settlement.
IBAN_SPACED = r"\b([A-Z]{2}\d{2}(?:[ ][A-Z]{4})?(?:[ ]\d{2,4}){2,5})\b"
IBAN_COMPACT = r"\b([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,4}[A-Z0-9]{1,4})\b"
MASKED_CARDS = r"\b(?:\d{6,}\*+\d{4}|[Xx]{4}-[Xx]{6}-\d{5}|[Xx]{10}\d{5})\b"
CARD_PAYMENT_PATTERNS = (r"HARTELIJK\s+BEDANKT\s+VOOR\s+UW\s+BETALING", r"AMERICAN\s+EXPRESS\s+EUROPE")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def without_markers(x: Column) -> Column:
    return F.regexp_replace(x, f"(?iU){MARKER_PATTERN}", "")


def normalised_for_import(x: Column) -> Column:
    """Without markers, white space collapsed, case kept; null is empty."""
    return collapsed(without_markers(F.coalesce(x, F.lit(""))))


def normalised(x: Column) -> Column:
    """As for import, in lower case: the form that fingerprints and ranks use."""
    return F.lower(normalised_for_import(x))


def plainly_normalised(x: Column) -> Column:
    return F.lower(collapsed(x))


def fingerprint(description: Column, amount: Column, currency: Column, date: Column, account: Column, index: Column) -> Column:
    """SHA-256 of the fields, joined by |; a null account is empty."""
    parts = [normalised(description), amount.cast("string"), currency, date.cast("string"), F.coalesce(account.cast("string"), F.lit("")), index.cast("string")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def grams(x: Column) -> Column:
    """Distinct three-character strings of a lower-cased text."""
    x = F.lower(x)
    return F.when(F.length(x) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3))))
    )


def dice(a: Column, b: Column) -> Column:
    """Shared grams twice over all grams; 1 for equal texts, 0 if either has none."""
    ga, gb = grams(a), grams(b)
    ratio = 2.0 * F.size(F.array_intersect(ga, gb)) / (F.size(ga) + F.size(gb))
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).when((F.size(ga) == 0) | (F.size(gb) == 0), F.lit(0.0)).otherwise(ratio)


def word_similarity(merchant: Column, description: Column) -> Column:
    """Best dice of the merchant's name with any window of as many words of the description."""
    m, d = plainly_normalised(merchant), plainly_normalised(description)
    n, words = F.size(F.split(m, " ")), F.split(d, " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    best = F.array_max(F.transform(windows, lambda w: dice(w, m)))
    return F.when((m == "") | (d == ""), F.lit(0.0)).when(F.size(words) < n, dice(d, m)).otherwise(best)


def payee_stem(x: Column) -> Column:
    """The first four words, without trailing numbers; one word always stays."""
    text = plainly_normalised(x)
    return F.array_join(F.slice(F.split(F.regexp_replace(text, r"(?U)(\s+[.,\-/]*\d+[.,\-/]*)+$", ""), " "), 1, 4), " ")


def _masked(x: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), x, lambda text, m: F.replace(text, m, mask(m)))


def redact_ibans(x: Column) -> Column:
    """Account numbers, spaced ones first, as ... and their last four characters."""
    def last_four(m: Column) -> Column:
        return F.concat(F.lit("..."), F.right(F.replace(m, F.lit(" "), F.lit("")), F.lit(4)))

    return _masked(_masked(x, IBAN_SPACED, last_four), IBAN_COMPACT, last_four)


def redact_cards(x: Column) -> Column:
    return F.regexp_replace(x, MASKED_CARDS, "****")


def clean_reference(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def clean_currency(x: Column) -> Column:
    """Three upper-case letters, or null."""
    code = F.upper(F.trim(x))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def european_number(x: Column) -> Column:
    """The later one of , and . is the decimal mark, the other groups; spaces go. Gives plain decimal text."""
    text = F.regexp_replace(x, r"(?U)\s", "")
    comma_last = F.instr(F.reverse(text), ",")
    dot_last = F.instr(F.reverse(text), ".")
    comma_is_mark = (comma_last > 0) & ((dot_last == 0) | (comma_last < dot_last))
    return F.when(comma_is_mark, F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(text, F.lit(","), F.lit("")))


def dutch_minor(x: Column) -> Column:
    """1.234,56 in minor units."""
    return F.translate(x, ".,", "").try_cast("long")


def english_minor(x: Column) -> Column:
    """€1,234.5 in minor units; the fraction is padded or cut to two digits."""
    text = F.regexp_replace(x, r"(?U)[€\s,]", "")
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return F.concat(whole, F.rpad(F.left(part, F.lit(2)), 2, "0")).try_cast("long")


def legend(x: Column) -> Column:
    """`xx = meaning` pairs of a line with two or more of them as a map; the first meaning of a code stays."""
    pair = F.lit(r"\b([a-z]{2})\s*=\s*(.+?)\s*(?=\b[a-z]{2}\s*=|$)")
    codes, meanings = F.regexp_extract_all(x, pair, F.lit(1)), F.regexp_extract_all(x, pair, F.lit(2))
    first = F.filter(F.arrays_zip(codes.alias("code"), meanings.alias("meaning")), lambda p, i: F.array_position(codes, p["code"]) == i + 1)
    return F.when(F.size(codes) >= 2, F.map_from_entries(first))


def distinct_ibans(x: Column) -> Column:
    """Compact account numbers of a text, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(IBAN_COMPACT), F.lit(1)))


def is_card_payment(x: Column) -> Column:
    return F.coalesce(x.rlike("(?iU)" + "|".join(CARD_PAYMENT_PATTERNS)), F.lit(False))
