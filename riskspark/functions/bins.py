"""Binning conventions. Edges are inner edges, ascending, given as an array column or a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(edges: Column | list[float]) -> Column:
    return edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")


def left_closed(x: Column, edges: Column | list[float]) -> Column:
    """[lo, hi): the number of inner edges at or below x. Tied edges leave empty bins."""
    return F.when(x.isNotNull(), F.size(F.filter(_array(edges), lambda e: e <= x)))


def right_closed(x: Column, edges: Column | list[float]) -> Column:
    """(lo, hi]: the number of inner edges below x."""
    return F.when(x.isNotNull(), F.size(F.filter(_array(edges), lambda e: e < x)))


def score_bin(p: Column, bins: int = 20) -> Column:
    """(lo, hi] of equal width on [0, 1], from 1; 0 is in bin 1, values over 1 in a bin of their own. The edges are
    multiples of the width in floating point, so that a score on an edge falls where array libraries put it."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i * F.lit(1.0 / bins))
    return F.when(p.isNotNull(), F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < p))))


def unique_edges(quantiles: Column) -> Column:
    """Quantile edges without repeats and with an edge at 0."""
    return F.array_sort(F.array_distinct(F.array_union(quantiles, F.array(F.lit(0.0)))))
