"""Feature selection: correlation filter, importance curves and their knee, unions of top features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.schema import col

from .ranks import quantiles

#: Which aggregate of a column is kept first when two are correlated.
PREFERENCE = {"mean": 1, "median": 1, "max": 2, "min": 2, "std": 3, "var": 3, "p95": 3, "last": 4}

#: Columns whose pairs are aggregates of one plan; more would make it too wide to compile.
FEW = 16


def preference(name: str) -> int:
    return PREFERENCE.get(name.partition("_")[0], 99)


def stacked(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, feature, x double): a row for each row and feature."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("x")) for f in features])
    return df.select(*[col(c) for c in keep or []], F.inline(cells))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair a before b, over the rows where both are known; null where one does not vary.

    Up to FEW columns are one aggregate a pair. Of more, each task adds up its rows' products in matrices and sends a row
    a pair; the pairs' sums are then spread over all tasks. Columns are shifted by their means first, so that the
    products do not cancel out.
    """
    k = len(columns)
    if k < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    if k <= FEW:
        pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
        both = lambda a, b: (F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b)))
        corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        row = df.agg(*[corr(*both(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))
    known = [F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in columns]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(known)])
    mean = [v or 0.0 for v in rows.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()]
    i, j = np.triu_indices(k, 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - mean
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            sx, sxx = x.T @ m, (x * x).T @ m
            part = np.stack([(m.T @ m)[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], (x.T @ x)[i, j]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t) for t in total]], ["i", "j", *names])

    sums = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names)).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    dx, dy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((dx > 0) & (dy > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(dx) * F.sqrt(dy)))
    name = lambda at: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)
    return sums.select(name("i").alias("a"), name("j").alias("b"), corr.alias("corr"))


def correlation_filter(df: DataFrame, columns: list[str], threshold: float = 0.8, keep: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(kept, dropped). Columns are taken in order; with each earlier one over the threshold, the aggregate of lower
    preference goes, on equal terms the one at hand. The scan over a column goes on even after it is dropped."""
    use = [c for c in columns if c not in keep]
    strong = {(r.a, r.b) for r in correlation_matrix(df, use).where(F.abs("corr") > threshold).collect()}  # pairs of columns
    gone: set[str] = set()
    for j, b in enumerate(use):
        if b in gone:
            continue
        for a in use[:j]:
            if (a, b) in strong and a not in gone:
                gone.add(a if preference(a) > preference(b) else b)
    return [c for c in columns if c not in gone], sorted(gone)


def importance_curve(importance: DataFrame) -> DataFrame:
    """(feature, gain) ranked: rank from 1, its share in percent, and the running share. A row a feature."""
    w = Window.orderBy(F.desc("gain"), "feature")
    total = F.sum("gain").over(Window.partitionBy())
    pct = F.col("gain") / total * 100.0
    return importance.select("feature", "gain", F.row_number().over(w).alias("rank"), pct.alias("gain_pct"), (F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total * 100.0).alias("cum_pct"))


def curve_points(curve: DataFrame, under: float = 1.0) -> DataFrame:
    """(elbow, k95, k90): the first position (from 0) whose share is under a percent, and how many features hold 95 and
    90 percent."""
    first = lambda cond: F.min(F.when(cond, F.col("rank")))
    return curve.agg((first(F.col("gain_pct") < under) - 1).alias("elbow"), first(F.col("cum_pct") >= 95).alias("k95"), first(F.col("cum_pct") >= 90).alias("k90"))


def knee(x: list[float], y: list[float], sensitivity: float = 1.0) -> float | None:
    """The knee of a convex falling curve by the Kneedle method (Satopää et al., 2011): both axes are scaled to [0, 1]
    and turned so that the curve rises and is concave; the first local maximum of the difference to the diagonal that
    then falls by `sensitivity` mean steps is the knee."""
    n = len(x)
    if n < 3 or x[-1] == x[0] or max(y) == min(y):
        return None
    xs = [(a - x[0]) / (x[-1] - x[0]) for a in x]
    low, high = min(y), max(y)
    d = [(high - b) / (high - low) - a for a, b in zip(xs, y)]
    step = sum(b - a for a, b in zip(xs, xs[1:])) / (n - 1)
    best, bar = None, 0.0
    for i in range(1, n - 1):
        if d[i] > d[i - 1] and d[i] >= d[i + 1]:
            best, bar = i, d[i] - sensitivity * step
        elif best is not None and d[i] < bar:
            return x[best]
    return x[best] if best is not None and d[-1] < bar else None


def top(importance: DataFrame, k: int, value: str = "gain") -> DataFrame:
    return importance.orderBy(F.desc(value), "feature").limit(k).select("feature")


def union_of_tops(gain: DataFrame, shap: DataFrame, k_gain: int = 276, k_shap: int = 201) -> DataFrame:
    """(feature): those among the first by gain or by mean absolute contribution, in order of name."""
    return top(gain, k_gain).union(top(shap, k_shap, "shap")).distinct().orderBy("feature")


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, na_rate, levels, min, median, max) of numeric columns: values are counted once for all of them."""
    rows = stacked(df, columns)
    counts = rows.groupBy("feature", "x").agg(F.count("*").alias("c"))
    known = F.col("x").isNotNull()
    g = counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(known, F.col("c"))), F.lit(0)).alias("n"), (F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)) / F.sum("c")).alias("na_rate"),
        F.count("x").alias("levels"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    m = quantiles(rows, "x", [0.5], ["feature"]).select("feature", F.col("q")[0].alias("median"))
    return g.join(m, "feature", "left").select("feature", "n", "na_rate", "levels", "min", "median", "max")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
