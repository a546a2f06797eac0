"""Conformal prediction sets for binary scores: split, rolling over weeks, by class, by risk bin, and weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.bins import right_closed
from riskspark.functions.numeric import clip, ratio
from riskspark.functions.schema import col

from .ranks import cumulate, held, on, quantiles

ALPHA, WINDOW, RISK_BINS, BIN_ROWS, CLASS_ROWS = 0.05, 6, 5, 200, 20


def symmetric(y: Column, p: Column) -> Column:
    return F.when(y == 1, 1.0 - p).otherwise(p)


def log_loss(y: Column, p: Column) -> Column:
    q = clip(p, 1e-12, 1 - 1e-12)
    return F.when(y == 1, -F.ln(q)).otherwise(-F.ln(1.0 - q))


def rank_quantile(df: DataFrame, value: Column, alpha: float = ALPHA) -> DataFrame:
    """(n, q): the k-th smallest value, k = min(n, ceil((n + 1)(1 - alpha))); values are counted before they are ordered."""
    c = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    n = c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    cum = cumulate(c, "v", ["c"]).join(F.broadcast(n), how="cross")
    k = F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    return cum.where(F.col("cum_c") >= k).agg(F.max("n").alias("n"), F.min("v").alias("q"))


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, q): the least value at which the running weight reaches q times the whole; null for no rows."""
    keys = keys or []
    g = df.where(col(value).isNotNull() & col(weight).isNotNull()).groupBy(*keys, col(value).alias("v")).agg(F.sum(weight).alias("w"))
    c = cumulate(g, "v", ["w"], keys)
    return c.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("cum_w") >= F.lit(q) * F.col("all_w"), F.col("v"))), F.max("v")).alias("q"))


def coverage(df: DataFrame, keys: list[str] | None = None, by_class: bool = True) -> DataFrame:
    """df has target, in0 and in1 (booleans): n, coverage, and the rates of empty, single and double sets."""
    hit = F.when(F.col("target") == 1, F.col("in1")).otherwise(F.col("in0")).cast("double")
    size = F.col("in0").cast("int") + F.col("in1").cast("int")
    out = [F.count("*").alias("n"), F.avg(hit).alias("coverage"), *[F.avg((size == k).cast("double")).alias(n) for k, n in enumerate(("empty_rate", "singleton_rate", "ambiguity_rate"))], F.avg(size).alias("avg_set_size")]
    if by_class:
        out += [e for k in (0, 1) for e in (F.sum((F.col("target") == k).cast("long")).alias(f"n_y{k}"), F.avg(F.when(F.col("target") == k, hit)).alias(f"coverage_y{k}"))]
    return df.groupBy(*(keys or [])).agg(*out)


def split_conformal(cal: DataFrame, test: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row: the calibration quantile of symmetric scores and how its sets do on test."""
    q = rank_quantile(cal, symmetric(col("target"), col("y_prob")), alpha).select(F.col("n").alias("n_val"), "q")
    x = test.join(F.broadcast(q), how="cross").select("n_val", "q", "target", (col("y_prob") <= F.col("q")).alias("in0"), ((1.0 - col("y_prob")) <= F.col("q")).alias("in1"))
    return coverage(x, ["n_val", "q"], by_class=False).select(F.lit(alpha).alias("alpha"), "n_val", "q", (1.0 - F.col("q")).alias("q_low"), F.col("q").alias("q_high"), F.col("coverage").alias("test_coverage"), "empty_rate", "singleton_rate", "ambiguity_rate", "avg_set_size")


def calibration_pairs(df: DataFrame, first_week: int, window: int = WINDOW, week: str = "WEEK_NUM") -> DataFrame:
    """df's rows under each target week (`wk`) that they calibrate: a row serves the `window` weeks after its own. The
    pairing is by equality after an explode of bounded length, not by a range join."""
    targets = df.where(col(week) >= first_week).select(col(week).alias("wk")).distinct()
    return df.withColumn("wk", F.explode(F.sequence(col(week) + 1, col(week) + window))).join(F.broadcast(targets), "wk")  # a row a week


def _class_q(rows: DataFrame, keys: list[str], alpha: float, weight: str | None) -> DataFrame:
    """(keys, n, n0, n1, q0, q1) of the log-loss scores by class."""
    s = log_loss(col("target"), col("y_prob"))
    y0, y1 = col("target") == 0, col("target") == 1
    n = rows.groupBy(*keys).agg(F.count("*").alias("n_cal"), F.sum(y0.cast("long")).alias("n0"), F.sum(y1.cast("long")).alias("n1"))
    scored = rows.where(col("target").isin(0, 1)).select(*keys, F.col("target").cast("int").alias("__y"), s.alias("__s"), *([col(weight)] if weight else []))
    q = quantiles(scored, "__s", [1 - alpha], [*keys, "__y"]).withColumn("q", F.col("q")[0]) if weight is None else weighted_quantile(scored, "__s", weight, 1 - alpha, [*keys, "__y"])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("__y") == k, F.col("q"))).alias(f"q{k}") for k in (0, 1)])
    return on(n, wide, keys, "left")


def global_thresholds(val: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(q0_global, q1_global) of a fixed calibration set; infinite for a class that is not there."""
    inf = F.lit(float("inf"))
    return _class_q(val, [], alpha, None).select(F.coalesce("q0", inf).alias("q0_global"), F.coalesce("q1", inf).alias("q1_global"))


def rolling_symmetric(df: DataFrame, first_week: int, alpha: float = ALPHA, window: int = WINDOW, weight: str | None = None, week: str = "WEEK_NUM") -> DataFrame:
    """(week, q, coverage...) with one threshold a week, by exact interpolated or weighted quantile of the weeks before."""
    cal = calibration_pairs(df, first_week, window, week)
    s = symmetric(col("target"), col("y_prob"))
    q = quantiles(cal.withColumn("__s", s), "__s", [1 - alpha], ["wk"]).withColumn("q", F.col("q")[0]) if weight is None else weighted_quantile(cal.withColumn("__s", s), "__s", weight, 1 - alpha, ["wk"])
    x = df.join(F.broadcast(q), col(week) == F.col("wk")).select(col(week), "q", "target", (col("y_prob") <= F.col("q")).alias("in0"), ((1.0 - col("y_prob")) <= F.col("q")).alias("in1"))
    return coverage(x, [week, "q"])


def rolling_mondrian(df: DataFrame, val: DataFrame, first_week: int, alpha: float = ALPHA, window: int = WINDOW, weight: str | None = None, least: int = CLASS_ROWS, week: str = "WEEK_NUM") -> DataFrame:
    """(week, q0, q1, fallback_q0, fallback_q1, coverage...) with a threshold a class; classes under `least` rows take the
    fixed set's."""
    q = _class_q(calibration_pairs(df, first_week, window, week), ["wk"], alpha, weight).join(F.broadcast(global_thresholds(val, alpha)), how="cross")
    few = [F.col(f"n{k}") < least for k in (0, 1)]
    q = q.select("wk", *[F.when(few[k], F.col(f"q{k}_global")).otherwise(F.col(f"q{k}")).alias(f"q{k}") for k in (0, 1)], *[few[k].cast("int").alias(f"fallback_q{k}") for k in (0, 1)])
    x = _with_sets(df.join(F.broadcast(q), col(week) == F.col("wk")))
    return coverage(x, [week, "q0", "q1", "fallback_q0", "fallback_q1"])


def _with_sets(x: DataFrame) -> DataFrame:
    p = col("y_prob")
    return x.withColumn("in0", log_loss(F.lit(0), p) <= F.col("q0")).withColumn("in1", log_loss(F.lit(1), p) <= F.col("q1"))


def rolling_binned(df: DataFrame, val: DataFrame, first_week: int, alpha: float = ALPHA, window: int = WINDOW, bins: int = RISK_BINS, weight: str | None = None, bin_rows: int = BIN_ROWS, class_rows: int = CLASS_ROWS, week: str = "WEEK_NUM") -> DataFrame:
    """(week, fallback rates, coverage...) with thresholds by class within bins of the calibration scores' quantiles.

    A bin under `bin_rows` rows takes the fixed set's thresholds for both classes, a class under `class_rows` for itself;
    the latter are counted only where the bin stands.
    """
    cal = calibration_pairs(df, first_week, window, week)
    e = held(quantiles(cal, "y_prob", [i / bins for i in range(1, bins)], ["wk"]).withColumnRenamed("q", "edges"))
    binned = lambda d: d.withColumn("bin", right_closed(col("y_prob"), F.col("edges")))
    cal = binned(cal.join(F.broadcast(e), "wk"))
    spine = e.select("wk", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    q = on(spine, _class_q(cal, ["wk", "bin"], alpha, weight), ["wk", "bin"], "left").join(F.broadcast(global_thresholds(val, alpha)), how="cross")
    thin = F.coalesce(F.col("n_cal"), F.lit(0)) < bin_rows
    few = [thin | (F.col(f"n{k}") < class_rows) for k in (0, 1)]
    q = q.select("wk", "bin", *[F.when(few[k], F.col(f"q{k}_global")).otherwise(F.col(f"q{k}")).alias(f"q{k}") for k in (0, 1)], thin.cast("double").alias("fb"), *[(~thin & (F.col(f"n{k}") < class_rows)).cast("double").alias(f"f{k}") for k in (0, 1)])
    q = held(q)
    rates = q.groupBy("wk").agg(F.avg("fb").alias("fallback_bin_rate"), F.avg("f0").alias("fallback0_rate"), F.avg("f1").alias("fallback1_rate"))
    x = binned(df.join(F.broadcast(e), col(week) == F.col("wk")))
    x = _with_sets(on(x, F.broadcast(q.select("wk", "bin", "q0", "q1")), ["wk", "bin"]))
    return on(coverage(x, [week]), rates.withColumnRenamed("wk", week), [week])


def summarize_weeks(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over weeks weighted by rows; a mean is null if any week lacks the value."""
    mean = lambda x, n: F.when(F.count(x) == F.count("*"), F.sum(F.col(x) * F.col(n)) / F.sum(n)).alias(x)
    return weekly.groupBy(*(keys or [])).agg(
        F.count("*").alias("weeks"), F.sum("n").alias("n_total"), *[mean(x, "n") for x in ("coverage", "empty_rate", "singleton_rate", "ambiguity_rate", "avg_set_size")], *[mean(f"coverage_y{k}", f"n_y{k}") for k in (0, 1)]
    )


def density_ratio(df: DataFrame, p: str = "g", calibration: int = 1, target: int = 1, cap: float = 0.99) -> DataFrame:
    """df with `w` = p / (1 - p) * calibration / target, capped at its own quantile."""
    q = clip(col(p), 1e-6, 1 - 1e-6)
    x = df.withColumn("w", q / (1.0 - q) * F.lit(calibration / max(1, target)))
    top = quantiles(x, "w", [cap]).select(F.col("q")[0].alias("__cap"))
    return x.join(F.broadcast(top), how="cross").withColumn("w", F.least("w", "__cap")).drop("__cap")
