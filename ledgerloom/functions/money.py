"""Exact money: integer minor units, half-even rounding, rates as pairs of integers.

A rate is num/den, so its inverse is a swap and a chain is two products; nothing is
rounded before the one division that gives minor units. Overflow is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rate with up to ten decimals is the integer rate * 10^10 over 10^10.
RATE_SCALE = 10**10
WIDE = "decimal(38,0)"


def pow10(exponent: Column) -> Column:
    """10^exponent for exponents 0 to 4, as a decimal."""
    return F.element_at(F.array(*[F.lit(10**i).cast("decimal(5,0)") for i in range(5)]), exponent + 1)


def half_even_div(n: Column, d: Column) -> Column:
    """n / d rounded half-even to a bigint, for n >= 0 and d > 0 (decimals without scale).

    ``div`` of decimals wraps silently beyond a bigint, so that is checked first.
    """
    q = F.when(n.cast("double") / d.cast("double") >= 9.2e18, F.raise_error(F.lit("amount out of range")).cast("bigint")).otherwise(_div(n, d))
    r = (n - q.cast("decimal(19,0)") * d).cast(WIDE)
    up = (2 * r > d) | ((2 * r == d) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def _div(n: Column, d: Column) -> Column:
    """Quotient of whole decimals; taking the remainder away first keeps ``/`` exact."""
    return ((n - n % d) / d).cast("bigint")


def ratio(minor: Column, num: Column, den: Column, from_exponent: Column, to_exponent: Column) -> tuple[Column, Column]:
    """Numerator and denominator of |minor| converted at num/den quote per base."""
    up = F.greatest(to_exponent - from_exponent, F.lit(0))
    down = F.greatest(from_exponent - to_exponent, F.lit(0))
    return (F.abs(minor).cast("decimal(18,0)") * num.cast("decimal(20,0)") * pow10(up)).cast(WIDE), (den.cast("decimal(33,0)") * pow10(down)).cast(WIDE)


def convert(minor: Column, num: Column, den: Column, from_exponent: Column, to_exponent: Column) -> Column:
    """Minor units of the quote currency for ``minor`` at num/den quote per base."""
    return F.signum(minor).cast("bigint") * half_even_div(*ratio(minor, num, den, from_exponent, to_exponent))


def with_converted(df: DataFrame, out: str, minor: Column, num: Column, den: Column, from_exponent: Column, to_exponent: Column) -> DataFrame:
    """Add ``out``: :func:`convert` column by column, so that the terms which it repeats are
    worked out once a row."""
    n, d, rest = F.col("__n"), F.col("__d"), F.col("__rest")
    top, bottom = ratio(minor, num, den, from_exponent, to_exponent)
    df = df.withColumns({"__n": top, "__d": bottom}).withColumn("__rest", n % d)
    whole = F.when(n.cast("double") / d.cast("double") >= 9.2e18, F.raise_error(F.lit("amount out of range")).cast("bigint")).otherwise(((n - rest) / d).cast("bigint"))
    df = df.withColumns({"__whole": whole, "__twice": (2 * rest).cast(WIDE)})
    q = F.col("__whole")
    up = (F.col("__twice") > d) | ((F.col("__twice") == d) & (q % 2 == 1))
    return df.withColumn(out, F.signum(minor).cast("bigint") * (q + F.when(up, 1).otherwise(0))).drop("__n", "__d", "__rest", "__whole", "__twice")


def rate_num(rate: Column) -> Column:
    """rate * 10^10 as a whole number; NULL if the rate has more decimals."""
    scaled = rate.cast("decimal(28,18)") * F.lit(RATE_SCALE).cast("decimal(11,0)")
    return F.when(scaled == F.floor(scaled), F.floor(scaled).cast("decimal(20,0)"))


def from_major(amount: Column, exponent: Column) -> Column:
    """Decimal major units to minor units, half-even."""
    return F.bround(amount.cast("decimal(24,10)") * pow10(exponent), 0).cast("bigint")


def to_major(minor: Column, exponent: Column) -> Column:
    """Minor units to decimal major units, exact, with four decimals."""
    scale = F.element_at(F.array(*[F.lit(f"{10**-i:.4f}").cast("decimal(5,4)") for i in range(5)]), exponent + 1)
    return (minor.cast("decimal(19,0)") * scale).cast("decimal(24,4)")


def line_total(quantity: Column, unit_minor: Column) -> Column:
    """quantity * unit price, half-even."""
    return F.bround(quantity.cast("decimal(12,6)") * unit_minor.cast("decimal(19,0)"), 0).cast("bigint")


def quantity_fits(quantity: Column, unit_minor: Column, total_minor: Column) -> Column:
    """Whether the quantity explains the total: |quantity * unit - total| < 1."""
    return F.abs(quantity.cast("decimal(12,6)") * unit_minor.cast("decimal(19,0)") - total_minor.cast("decimal(19,0)")) < 1


def fit_decimals(minor: Column, from_exponent: Column, to_exponent: Column) -> Column:
    """An amount written with the decimals of another currency: cut towards zero, sign kept."""
    up, down = pow10(F.greatest(to_exponent - from_exponent, F.lit(0))), pow10(F.greatest(from_exponent - to_exponent, F.lit(0)))
    size = F.abs(minor).cast("decimal(19,0)")
    return (F.signum(minor).cast("bigint") * ((size - size % down) / down * up).cast("bigint")).cast("bigint")


def withdrawal_fee(charged: Column, foreign: Column, fixed_minor: Column, fixed_same_currency: Column, percent: Column) -> Column:
    """Fixed fee plus percentage of a charge in foreign currency, half-even; a fixed fee in
    another currency stands alone; no fee is NULL."""
    part = F.when(foreign & (F.coalesce(percent, F.lit(0)) > 0), F.bround(charged.cast("decimal(19,0)") * percent.cast("decimal(7,4)") * F.lit("0.01").cast("decimal(3,2)"), 0).cast("bigint")).otherwise(F.lit(0))
    fixed = F.coalesce(fixed_minor, F.lit(0)).cast("bigint")
    return F.nullif(F.when(fixed == 0, part).when(fixed_same_currency, fixed + part).otherwise(fixed), F.lit(0))


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def amount_text(minor: Column, exponent: Column, decimal_mark: str = ".") -> Column:
    """Minor units with the currency's fixed decimals, no grouping."""
    size = F.abs(minor).cast("string")
    padded = F.when(F.length(size) > exponent, size).otherwise(F.concat(F.repeat(F.lit("0"), exponent + 1 - F.length(size)), size))
    whole = padded.substr(F.lit(1), F.length(padded) - exponent)
    part = padded.substr(F.length(padded) - exponent + 1, exponent)
    return F.concat(F.when(minor < 0, "-").otherwise(""), whole, F.when(exponent > 0, F.concat(F.lit(decimal_mark), part)).otherwise(""))


def money_text(minor: Column, exponent: Column, symbol: Column) -> Column:
    """Grouped amount with its symbol in front."""
    plain = amount_text(F.abs(minor), exponent)
    whole = F.regexp_replace(F.regexp_extract(plain, r"^\d+", 0), r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.concat(F.when(minor < 0, "-").otherwise(""), symbol, whole, F.regexp_extract(plain, r"\..*$", 0))


def parse_amount(text: Column, exponent: Column, decimal_mark: str = ".") -> Column:
    """Typed amount to minor units: digits, at most one decimal mark, no more decimals than
    the currency has; otherwise NULL."""
    mark = "\\" + decimal_mark
    clean = F.trim(text)
    good = clean.rlike(rf"^\d{{1,15}}({mark}\d*)?$")
    whole = F.regexp_extract(clean, r"^\d+", 0)
    part = F.regexp_extract(clean, rf"{mark}(\d*)$", 1)
    digits = F.concat(whole, part, F.repeat(F.lit("0"), F.greatest(exponent - F.length(part), F.lit(0))))
    return F.when(good & (F.length(part) <= exponent), F.when(good & (F.length(part) <= exponent), digits).cast("bigint"))
