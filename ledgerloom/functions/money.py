"""Money expressions: integers of minor units and decimals, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASE_AMOUNT


def minor_from_number(x: Column) -> Column:
    """A number of two decimals (double or decimal) in cents, half up."""
    return F.round(x.cast("decimal(18,4)") * 100, 0).cast("long")


def cents(x: Column) -> Column:
    """A decimal sum in cents, rounded once, half up and away from zero."""
    return (F.round(x, 2) * 100).cast("long")


def base_from_minor(amount: Column) -> Column:
    """Cents as a base amount."""
    return (amount.cast("decimal(18,0)") * F.expr("0.01BD")).cast(BASE_AMOUNT)


def to_minor(x: Column, decimals: int) -> Column:
    """A decimal in minor units of a currency with so many decimals, half up."""
    return (F.round(x, decimals) * F.expr(f"{10**decimals}BD")).cast("long")


def from_minor(amount: Column, decimals: int) -> Column:
    """Minor units as a decimal; exact."""
    if decimals == 0:
        return amount.cast("decimal(18,0)")
    return amount.cast("decimal(18,0)") * F.expr(f"{10**-decimals:.{decimals}f}BD")


def power_of_ten(n: Column) -> Column:
    """10^n as a decimal, n from 0 to 18."""
    return F.rpad(F.lit("1"), n.cast("int") + 1, F.lit("0")).cast("decimal(19,0)")


def converted(amount: Column, rate: Column, decimals: Column | int = 2) -> Column:
    """Base amount of minor units of a currency with so many decimals, at a rate (foreign units for one base unit): four
    decimals, half up and away from zero. Null where the rate isn't positive or the result has no place in BASE_AMOUNT.

    A quotient of whole numbers, so no digit is lost: amount / 10^decimals / rate in ten-thousandths is
    amount * 10^14 / (rate * 10^10 * 10^decimals)."""
    d = F.lit(decimals) if isinstance(decimals, int) else decimals
    scaled = F.abs(amount.cast("decimal(19,0)")) * F.expr("100000000000000BD")
    per = F.try_multiply((F.when(rate > 0, rate).cast("decimal(20,10)") * F.expr("10000000000BD")).cast("decimal(20,0)"), power_of_ten(d))
    # A result of 18 digits at most; a product beyond 38 digits is larger than any amount.
    fits = scaled < F.coalesce(F.try_multiply(per, F.expr("100000000000000000BD")), F.expr("99999999999999999999999999999999999999BD"))
    whole = F.when(fits, F.call_function("div", 2 * scaled + per, 2 * per))
    return (F.when(amount < 0, -whole).otherwise(whole).cast("decimal(18,0)") * F.expr("0.0001BD")).cast(BASE_AMOUNT)


def counter_amount(base: Column, decimals: int = 2) -> Column:
    """Minor units of the counter leg of a base amount."""
    return to_minor(-base, decimals)


def debit_from_positive(amount: Column) -> Column:
    """Statements that print debits as positive numbers: every amount becomes negative."""
    return -F.abs(amount)


def grouped(amount: Column) -> Column:
    """An integer with a comma between groups of three digits."""
    return F.format_number(amount, 0)


def display(amount: Column, decimals: int, symbol: str = "") -> Column:
    """Minor units for people: sign (U+2212), symbol, grouped units, fraction."""
    scale = F.lit(10**decimals)
    whole = F.abs(amount)
    text = F.concat(F.when(amount < 0, F.lit("−")).otherwise(F.lit("")), F.lit(symbol), grouped(F.floor(whole / scale).cast("long")))
    return text if decimals == 0 else F.concat(text, F.lit("."), F.lpad((whole % scale).cast("string"), decimals, "0"))


def parse_signed(text: Column, decimals: int = 2, most: int = 999_999_999_999) -> Column:
    """Minor units of typed text (comma or dot, optional sign); null if it isn't an amount, has too many decimals or is too large."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit("."))
    ok = clean.rlike(rf"^[+-]?[0-9]{{1,13}}(\.[0-9]{{1,{decimals}}})?$") if decimals else clean.rlike(r"^[+-]?[0-9]{1,13}$")
    minor = clean.try_cast(f"decimal(18,{decimals})") * 10**decimals
    return F.when(ok & (F.abs(minor) <= most), minor.cast("long"))


def axis_domain(low: Column, high: Column, ticks: int = 5) -> tuple[Column, Column, Column]:
    """Floor, ceiling and step of an axis: at least 12 % of the middle high, a nice step times a power of ten."""
    middle = (low + high) / 2
    wanted = F.greatest(high - low, F.abs(middle) * 0.12, F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(wanted / ticks)))
    steps = F.array(*[F.lit(float(x)) for x in (1, 2, 2.5, 5, 10)])
    step = F.coalesce(F.get(F.filter(steps, lambda s: s * power * ticks >= wanted), F.lit(0)) * power, power * 10)
    return F.floor((middle - wanted / 2) / step) * step, F.ceil((middle + wanted / 2) / step) * step, step


def same_currency(result: Column, *currencies: Column) -> Column:
    """A sum or difference of amounts whose currencies must be one; fails the query where they aren't."""
    alike = F.lit(True)
    for c in currencies[1:]:
        alike = alike & c.eqNullSafe(currencies[0])
    return F.when(alike, result).otherwise(F.raise_error(F.lit("amounts of different currencies")).cast("long"))
