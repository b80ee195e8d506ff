"""Rounding, guards and ratios. Every other module rounds and divides through these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Half-up rounding as floor(x * 10^n + 0.5) / 10^n: -2.5 becomes -2, unlike round() and bround()."""
    power = float(10**digits)
    return F.floor(x * power + 0.5) / power


def finite(x: Column) -> Column:
    """Measured: not null, no NaN, no infinity."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole; null where the whole is null or not above zero."""
    value = F.when(whole > 0, part / whole)
    return value if digits is None else half_up(value, digits)


def mean_where(x: Column, condition: Column, digits: int = 1) -> Column:
    """Rounded mean of x over the rows where the condition holds; null if there are none."""
    return half_up(F.avg(F.when(condition, x)), digits)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the pairs without nulls from their sums; null for under two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c).cast("double") for c in (x, y))
    n = F.count(x)
    xx, yy = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return F.when((n > 1) & (xx > 0) & (yy > 0), (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / F.sqrt(xx * yy))


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y on x; null if x doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c).cast("double") for c in (x, y))
    n = F.count(x)
    xx = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(xx > 0, (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / xx)


#: Lower bounds of the score bands, best first.
BANDS = {"default": [(85, "excellent"), (70, "strong"), (55, "good"), (40, "fair"), (0, "poor")], "rubric": [(90, "excellent"), (75, "strong"), (60, "good"), (40, "fair"), (0, "poor")]}


def band(score: Column, scale: str = "default") -> Column:
    """Name of a score's band; null for no score."""
    out = F.lit(None).cast("string")
    for least, name in reversed(BANDS[scale]):
        out = F.when(score >= least, name).otherwise(out)
    return out
