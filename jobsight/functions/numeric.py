"""Numeric column helpers with the null, zero and rounding rules of the job store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
MIB = 1024**2
GIB = 1024**3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x, digits: int = 0) -> Column:
    """Round half to even on the double itself."""
    scale = float(10**digits)
    return F.rint(_c(x).cast("double") * F.lit(scale)) / F.lit(scale)


def fixed(x, digits: int) -> Column:
    """Text with so many decimals, rounded half to even on the double itself."""
    return F.call_function("format_number", _c(x).cast("double"), F.lit(f"0.{'0' * digits}" if digits else "0"))


def ratio(num, den, default: float = 0.0) -> Column:
    """num / den as double, or the default when the denominator is not positive."""
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den).cast("double")).otherwise(F.lit(default))


def truthy_or(first, fallback) -> Column:
    """``first`` unless it is null or zero, else ``fallback``."""
    return F.coalesce(F.nullif(_c(first), F.lit(0)), _c(fallback))


def zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def to_gib(x) -> Column:
    return _c(x).cast("double") / F.lit(float(GIB))


def clamp(x, low, high) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(_c(x), lo), hi)


def mean_of(x) -> Column:
    """Mean of whole numbers from an exact sum, so the order of addition cannot matter."""
    return F.sum(_c(x)).cast("double") / F.nullif(F.count(_c(x)), F.lit(0))


def long_sum(x) -> Column:
    return F.sum(_c(x)).cast("long")


def share(condition: Column) -> Column:
    return F.count_if(condition).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))


def collected(*items: tuple[Column, Column]) -> Column:
    """Array of the values whose condition is true, in order; each item is (condition, value).

    Built from array concatenation, which stays in generated code; a filter over an array would not.
    """
    return F.concat(*[F.when(condition, F.array(value)).otherwise(F.array()) for condition, value in items])


def sum_of(*conditions: Column) -> Column:
    """How many of the conditions are true."""
    out = F.lit(0)
    for c in conditions:
        out = out + F.when(c, 1).otherwise(0)
    return out
