"""Quality rules: repetition counts and distribution divergence from language references.

Everything is DataFrame expressions; no Python runs on the rows, and only sums by language are shuffled.

A document has two histograms: of character classes and of common words. Each is compared with a
reference of the document's `lang` by Jensen-Shannon distance (base 2, so between 0 and 1). The
references are a parameter, such as what `references()` sums up over a corpus, a row for each listed
language. By default those of characters, and of the words as they are written (`word_distance`), are
the fixed tables below, and those of the words without case and punctuation are summed up over the
documents themselves. The verdict takes the latter: the distance must stay below a share of that of a
text without any common word, a larger share the fewer common words a text of its length would have, so
that chance doesn't reject short clean texts. A language without a reference has its words not judged and
its characters compared with the reference of `REST`. Texts under `MIN_CHARS` word characters are too
short for a histogram and are judged by the base rules alone.

Defined results: null or empty text has no words, fails the base rules and is not kept; a null lang
counts as one without reference; repeated documents are judged row by row; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE

MIN_WORDS = 50
MIN_CHARS = 200
#: Largest Jensen-Shannon distance of classes of a kept document.
MAX_CLASS_DISTANCE = 0.2
#: Largest distance of common words, as a share of that of a text without any; WORD_SLACK over the number of common words
#: to expect is added.
MAX_WORD_SHARE = 0.65
WORD_SLACK = 2.3

CLASSES = ("letter", "digit", "space", "punctuation", "other")
REST = "*"

# Shares of character classes in running text, in the order of CLASSES.
CLASS_SHARES = {
    "en": (0.800, 0.004, 0.165, 0.030, 0.001),
    "de": (0.815, 0.004, 0.145, 0.035, 0.001),
    "fr": (0.795, 0.004, 0.165, 0.035, 0.001),
    "es": (0.800, 0.004, 0.165, 0.030, 0.001),
    REST: (0.800, 0.004, 0.160, 0.035, 0.001),
}
# Frequent function words of four languages and their shares of all words.
WORD_SHARES = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.025, "in": 0.020, "a": 0.020, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.009, "with": 0.007, "was": 0.007},
    "de": {"der": 0.032, "die": 0.032, "und": 0.027, "den": 0.012, "von": 0.010, "zu": 0.010, "das": 0.010, "mit": 0.009, "sich": 0.008, "des": 0.008, "ein": 0.007, "dem": 0.007},
    "fr": {"de": 0.045, "la": 0.029, "le": 0.024, "et": 0.022, "les": 0.020, "des": 0.018, "du": 0.012, "que": 0.010, "est": 0.009, "en": 0.011, "un": 0.009, "une": 0.008},
    "es": {"de": 0.055, "la": 0.037, "que": 0.030, "el": 0.028, "en": 0.025, "los": 0.017, "se": 0.013, "del": 0.012, "las": 0.011, "un": 0.010, "por": 0.010, "con": 0.009},
}
VOCABULARY = sorted({w for words in WORD_SHARES.values() for w in words})


def default_references() -> dict[str, tuple[list[float], list[float] | None, list[float] | None]]:
    """By language the shares of character classes and of common words, the rest of the words last; none of folded words."""
    out: dict = {}
    for lang, classes in CLASS_SHARES.items():
        words = WORD_SHARES.get(lang)
        out[lang] = list(classes), words and [*(words.get(w, 0.0) for w in VOCABULARY), 1 - sum(words.values())], None
    return out


def _filtered(words: Column) -> Column:
    """The common words of an array of words, each between two spaces of its own."""
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(VOCABULARY)), "  "), F.lit(" "))


def _with_words(docs: DataFrame) -> DataFrame:
    trimmed = F.btrim(F.coalesce(F.col("_text"), F.lit("")), F.lit(WHITESPACE))
    return docs.withColumn("_trimmed", trimmed).withColumn(
        "_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", r"[\x20\x09-\x0D]+"))
    )


def _common_counts(joined: str, n_words: Column) -> Column:
    """Counts of the common words in a column that _filtered() made, and of all other words."""
    counts = F.array(*[((F.length(joined) - F.length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in VOCABULARY])
    common = F.regexp_count(joined, F.lit(r"\p{L}+"))
    return F.concat(counts, F.array((n_words - common).cast("double")))


def _histograms(df: DataFrame) -> DataFrame:
    """Appends _classes, _common and _folded_common, arrays of counts; needs _text and _words."""
    plain = F.btrim(F.regexp_replace(F.lower("_trimmed"), r"[^\p{L}\x20\x09-\x0D]+", ""), F.lit(WHITESPACE))
    df = df.withColumn("_plain", plain).withColumn(
        "_folded", F.when(F.col("_plain") == "", F.array().cast("array<string>")).otherwise(F.split("_plain", r"[\x20\x09-\x0D]+"))
    )
    df = df.withColumns({
        "_length": F.coalesce(F.length("_text"), F.lit(0)),
        "_no_letter": F.regexp_replace(F.coalesce("_text", F.lit("")), r"\p{L}+", ""),
        "_joined": _filtered(F.col("_words")),
        "_folded_joined": _filtered(F.col("_folded")),
    })
    df = df.withColumns({
        "_space": F.length("_no_letter") - F.length(F.translate("_no_letter", WHITESPACE, "")),
        "_digits": F.regexp_count("_no_letter", F.lit("[0-9]")),
        "_punctuation": F.regexp_count("_no_letter", F.lit(r"[.,;:!?'\"()\-]")),
    })
    df = df.withColumn("_word_chars", (F.col("_length") - F.col("_space")).cast("long"))
    letters, space = F.col("_length") - F.length("_no_letter"), F.col("_space")
    classes = [
        letters, F.col("_digits"), space, F.col("_punctuation"),
        F.length("_no_letter") - F.col("_digits") - F.col("_punctuation") - space,
    ]
    return df.withColumns({
        "_classes": F.array(*[c.cast("double") for c in classes]),
        "_common": _common_counts("_joined", F.size("_words")),
        "_folded_common": _common_counts("_folded_joined", F.size("_folded")),
    })


def _language(column: str = "_lang") -> Column:
    return F.when(F.col(column).isin(list(WORD_SHARES)), F.col(column)).otherwise(F.lit(REST))


def _summed(docs: DataFrame, histograms: dict[str, int]) -> dict[str, tuple[list[float], ...]]:
    """By listed language, and for the rest, sums of histograms (column: length) over all documents."""
    df = _histograms(_with_words(docs.select(F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))))
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in histograms.items() for i in range(n)]
    rows = df.groupBy(_language().alias("lang")).agg(*sums).collect()  # at most one for each listed language, and the rest
    return {r["lang"]: tuple([r[f"{c}{i}"] for i in range(n)] for c, n in histograms.items()) for r in rows}


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float], list[float]]]:
    """References from a corpus: of character classes, common words, and common words without case and punctuation."""
    return _summed(docs, {"_classes": len(CLASSES), "_common": len(VOCABULARY) + 1, "_folded_common": len(VOCABULARY) + 1})


def _references_for(docs: DataFrame) -> dict[str, tuple]:
    """The default: fixed tables, and for the listed languages the documents' own common words."""
    own = _summed(docs, {"_folded_common": len(VOCABULARY) + 1})
    return {lang: (*reference[:2], own.get(lang, (None,))[0] if lang != REST else None) for lang, reference in default_references().items()}


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 where either is empty."""
    def normal(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.transform(c, lambda x: F.try_divide(x, total))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(normal(counts), normal(reference), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _reference_column(by_language: dict, which: int) -> Column:
    def literal(counts):
        total = sum(counts) or 1.0
        return F.array(*[F.lit(float(x) / total) for x in counts])

    column = literal(by_language[REST][which]) if by_language.get(REST, (None,) * 3)[which] else F.lit(None).cast("array<double>")
    for lang in sorted(x for x, reference in by_language.items() if x != REST and reference[which]):
        column = F.when(_language() == lang, literal(by_language[lang][which])).otherwise(column)
    return column


def _most_word_distance(n_words: Column, by_language: dict) -> Column:
    """The largest distance of common words that a text of n_words may have; null where its language has no reference."""
    out = F.lit(None).cast("double")
    for lang, reference in sorted(by_language.items()):
        if counts := reference[2]:
            share = 1 - counts[-1] / (sum(counts) or 1.0)
            # Divergence from the reference of a text without common words.
            divergence = (share + (1 - share) * math.log2((1 - share) / (1 - share / 2)) - math.log2(1 - share / 2)) / 2 if share < 1 else 1.0
            limit = math.sqrt(max(divergence, 0.0)) * (F.lit(MAX_WORD_SHARE) + F.try_divide(F.lit(WORD_SLACK), n_words * F.lit(share)))
            out = F.when(_language() == lang, limit).otherwise(out)
    return out


def _repeats(df: DataFrame) -> DataFrame:
    """Appends n_repeat_words: words in windows of three words that the text has twice or more.

    Equal windows meet by sorting (hash, index) pairs inside the row, so a row costs n log n; texts whose
    windows all differ, which most do, are not sorted."""
    n = F.size("_words")
    df = df.withColumn(
        "_windows",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
        .otherwise(F.array().cast("array<bigint>")),
    ).withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(
        "_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)
    )
    # An element repeats if its neighbour on either side has the same hash: zip the array with itself, shifted.
    same = F.transform("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)))
    df = df.withColumn("_next", same)
    flagged = F.filter("_sorted", lambda x, k: F.get("_next", k) | F.coalesce(F.get("_next", k - 1), F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(flagged, lambda x: x["i"])))
    covered = F.transform("_at", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - v, F.lit(3))))
    return df.withColumn("_n_repeat", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))


def _measure(df: DataFrame, by_language: dict) -> DataFrame:
    """Appends the measures and the verdict to a frame with _text and _lang."""
    df = _repeats(_histograms(_with_words(df)))
    df = df.withColumn("_lines", F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != ""))
    df = df.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_n_symbols": F.regexp_count("_no_letter", F.lit(r"[#*$%&|<>]")).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_class_distance": F.coalesce(_distance(F.col("_classes"), _reference_column(by_language, 0)), F.lit(0.0)),
        "_word_distance": F.coalesce(_distance(F.col("_common"), _reference_column(by_language, 1)), F.lit(0.0)),
        "_folded_distance": _distance(F.col("_folded_common"), _reference_column(by_language, 2)),
        "_most_distance": _most_word_distance(F.size("_folded"), by_language),
    })
    df = df.withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat") > 50 * F.col("_n_words")))
    near = (F.col("_class_distance") <= MAX_CLASS_DISTANCE) & F.coalesce(F.col("_folded_distance") <= F.col("_most_distance"), F.lit(True))
    df = df.withColumn("_kept", ~F.col("_base_failed") & ((F.col("_word_chars") < MIN_CHARS) | near))
    # A filter on a verdict would be pushed below all these projections, and each measure written out again wherever it
    # is used. A column that the planner can't move keeps filters above it.
    df = df.withColumn("_barrier", F.monotonically_increasing_id() >= 0)
    return df.withColumns({c: F.col(c) & F.col("_barrier") for c in ("_base_failed", "_kept")})


def quality_report(docs: DataFrame, by_language: dict | None = None) -> DataFrame:
    """One row per document: the base counts, both distances, base_failed and kept."""
    by_language = by_language or _references_for(docs)
    df = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "class_distance", "word_distance", "base_failed", "kept")
    return _measure(df, by_language).select(*[F.col(f"_{x}").alias(x) for x in names], F.col("_n_repeat").alias("n_repeat_words"))


def keep_good(docs: DataFrame, by_language: dict | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    by_language = by_language or _references_for(docs)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    return _measure(df, by_language).where("_kept").select("_row.*")
