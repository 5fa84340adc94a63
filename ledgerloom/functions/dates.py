"""Date expressions. Parsing never fails: what is no date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats after ISO, in the order they are tried.
FORMATS = (("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
           ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"), ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), ("yyyyMMdd", r"^\d{8}$"))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _try_date(x: Column, form: str) -> Column:
    return F.try_to_timestamp(x, F.lit(form)).cast("date")


def parse_date(x: Column) -> Column:
    text = F.trim(x)
    tried = [F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), _try_date(text, "yyyy-MM-dd"))]
    return F.coalesce(*tried, *[F.when(text.rlike(shape), _try_date(text, form)) for form, shape in FORMATS])


def pivot_year(yy: Column) -> Column:
    """Two-digit years above 80 are of the last century."""
    return F.when(yy > 80, yy + 1900).otherwise(yy + 2000)


def infer_year(month: Column, start: Column, end: Column) -> Column:
    """Year of a row that prints day and month only: the period's end year, but December of a period over new year has the start's."""
    return F.when((F.year(start) < F.year(end)) & (month == 12), F.year(start)).otherwise(F.year(end))


def month_name_date(x: Column) -> Column:
    """`5 Sept 2025` and the like."""
    parts = F.split(F.trim(x), r"\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.left(F.lower(F.get(parts, 1)), F.lit(3)))
    good = x.rlike(r"^\s*\d{1,2}\s+[A-Za-z]{3,4}\s+\d{4}\s*$") & (month > 0)
    iso = F.concat_ws("-", F.get(parts, 2), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(parts, 0), 2, "0"))
    return F.when(good, _try_date(iso, "yyyy-MM-dd"))


def period(d: Column, by: str) -> Column:
    """Label of the day, the week (its Monday) or the month of a date."""
    if by == "month":
        return F.date_format(d, "yyyy-MM")
    return (F.trunc(d, "week") if by == "week" else d).cast("string")


def calendar(start: Column, end: Column) -> Column:
    """All days from start to end; none if they are the wrong way round."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def days_span(day: Column, window: tuple[int, int]) -> Column:
    """The number of the span of days that a day is in; spans are as long as a window of (first, last) days."""
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (window[1] - window[0] + 1)).cast("int")


def spans_between(first: Column, last: Column, window: tuple[int, int]) -> Column:
    """The spans that the days from first to last are in, two at most if they are a window apart; none if either is null."""
    return F.when(first.isNotNull() & last.isNotNull(), F.sequence(days_span(first, window), days_span(last, window)))
