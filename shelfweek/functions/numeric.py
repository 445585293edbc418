"""Guarded arithmetic, text normalising and small expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return _col(c).cast("double")


def ratio(num, den) -> Column:
    """num / den in double, NULL when the divisor is zero."""
    return F.try_divide(dbl(num), dbl(den))


def ratio_or(num, den, other: float = 0.0) -> Column:
    """num / den in double, ``other`` when the divisor is zero (NULL divisor stays NULL)."""
    den = dbl(den)
    return F.when(den == 0, F.lit(float(other))).otherwise(F.try_divide(dbl(num), den))


def money(c) -> Column:
    """Double rounded to cents, halves away from zero, as ``decimal(18,2)``."""
    whole = F.floor(F.abs(dbl(c)) * 100 + 0.5).cast("decimal(16,0)")
    return (F.when(dbl(c) < 0, -whole).otherwise(whole) / 100).cast(MONEY)


def half_up_cents(numerator, denominator) -> Column:
    """Integer quotient of cents, halves away from zero, as ``decimal(18,2)``."""
    num, den = F.abs(_col(numerator)), F.abs(_col(denominator))
    whole = F.call_function("div", num * 2 + den, den * 2)
    cents = F.when((_col(numerator) < 0) != (_col(denominator) < 0), -whole).otherwise(whole)
    return (cents.cast("decimal(16,0)") / 100).cast(MONEY)


def trunc_avg(c) -> Column:
    """Average of whole numbers truncated toward zero, as integer averages are."""
    return F.try_divide(F.sum(dbl(c)), F.count(_col(c)).cast("double")).cast("int")


def exact_avg(c) -> Column:
    """Average of a decimal column as sum/count in double (no decimal rounding)."""
    return ratio(F.sum(_col(c)), F.count(_col(c)))


def fixed_avg(c) -> Column:
    """Average of doubles summed as 12-place decimals: the same whatever order rows arrive in."""
    return ratio(F.sum(_col(c).cast("decimal(30,12)")), F.count(_col(c)))


def link_line(attribute, key) -> Column:
    """Pricing group; the placeholders 'NULL' and '' fall back to the product's own key."""
    attribute = _col(attribute)
    return F.when(attribute.isin("NULL", ""), _col(key).cast("string")).otherwise(attribute)
