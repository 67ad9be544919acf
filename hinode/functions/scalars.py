"""Column expressions: codes, coercions, clamped scales and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed texts that mean true or false in stored flags.
TRUE_TEXTS = ("true", "t", "yes", "y", "on", "1", "1.0")
FALSE_TEXTS = ("false", "f", "no", "n", "off", "0", "0.0", "")


def normalize_code(c: Column) -> Column:
    """Digits of a security code; four digits get a closing 0."""
    digits = F.regexp_replace(F.trim(c.cast("string")), r"\D", "")
    return F.when(F.length(digits) == 4, F.concat(digits, F.lit("0"))).when(F.length(digits) > 0, digits)


def display_code(c: Column) -> Column:
    """Four digits of a five-digit code that ends in 0."""
    return F.when((F.length(c) == 5) & c.endswith("0"), F.substring(c, 1, 4)).otherwise(c)


def coerce_flag(c: Column) -> Column:
    """True, false or null from booleans, numbers and texts."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)


def finite(c: Column) -> Column:
    """A number, with NaN and infinities as null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is above 0, else null."""
    return F.when(denominator > 0, numerator / denominator)


def scale(value: Column, low: float, high: float, points: float, inverse: bool = False) -> Column:
    """Points in proportion to where the value lies between low and high; null gives 0, inverse or not."""
    x = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    # least and greatest pass over nulls, so null is told apart first
    return F.when(value.isNull(), 0.0).otherwise((1.0 - x if inverse else x) * points)


def clip(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def passes(condition: Column) -> Column:
    """A predicate for filters: unknown fails."""
    return F.coalesce(condition, F.lit(False))


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounding by the same floating-point steps in every engine."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def cagr(first: Column, last: Column, steps: Column) -> Column:
    return F.when((steps > 0) & (first > 0) & (last > 0), F.pow(last / first, 1.0 / F.greatest(steps, F.lit(1))) - 1.0)


def joined_reasons(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(passes(c), F.lit(label)) for label, c in pairs]))
