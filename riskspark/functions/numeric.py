"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null (least and greatest alone would skip it)."""
    y = x
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    return F.when(x.isNotNull(), y)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1.0 - q))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def rounded(x: Column, scale: float = 1e6) -> Column:
    """To six digits, half up, by a rule that every engine computes alike."""
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def finite(x: Column, other: float = 0.0) -> Column:
    """x as a double; infinite, NaN and null values replaced."""
    y = x.cast("double")
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), F.lit(other)).otherwise(y)
