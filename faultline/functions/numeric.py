"""Rounding and ratio expressions with the same last digit as Python and JavaScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole as double; `empty` where whole is zero."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty).cast("double"))


def _scaled(x: Column, digits: int) -> tuple[Column, Column, Column]:
    """Whole part of x * 10^digits, and the exact sign of what is left over one half.

    The product of a double and a small power of ten is split into two doubles, so that a decimal that
    only looks like a tie (2.675 is below it) is told apart from a real one (0.125).
    """
    factor = F.lit(float(10**digits))
    x = x.cast("double")
    product = x * factor
    shifted = x * F.lit(134217729.0)
    high = shifted - (shifted - x)
    rest = (high * factor - product) + (x - high) * factor
    whole = F.floor(product).cast("double")
    over = (product - whole - F.lit(0.5)) + rest
    return whole, over, factor


def round_half_even(x: Column, digits: int) -> Column:
    """Rounding as Python's round(x, digits): exact binary value, real ties to the even digit."""
    whole, over, factor = _scaled(x, digits)
    odd = (whole % 2) != 0
    return (whole + F.when((over > 0) | ((over == 0) & odd), 1.0).otherwise(0.0)) / factor


def fixed_text(x: Column, digits: int) -> Column:
    """Text as JavaScript's toFixed(digits) for numbers at or above zero: real ties go up."""
    whole, over, factor = _scaled(x, digits)
    value = (whole + F.when(over >= 0, 1.0).otherwise(0.0)).cast("decimal(24,0)")
    if digits == 0:
        return value.cast("string")
    return (value / F.lit(10**digits).cast("decimal(10,0)")).cast(f"decimal(28,{digits})").cast("string")


def percent_text(x: Column, digits: int = 0) -> Column:
    """x as a percentage the way Python's `.0%` writes it."""
    value = round_half_even(x.cast("double") * 100, digits)
    return F.concat(value.cast(f"decimal(24,{digits})").cast("string"), F.lit("%"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x kept inside [low, high]; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
