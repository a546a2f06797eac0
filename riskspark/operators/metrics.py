"""Ranking and calibration metrics of binary scores, overall or by group, from one pass of pre-aggregated score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.bins import score_bin
from riskspark.functions.numeric import ratio
from riskspark.functions.schema import col

from .ranks import cumulate, on, quantiles

def valid_predictions(df: DataFrame, keep: list[str] | None = None, clip_scores: bool = False) -> DataFrame:
    """target as int and y_prob as double, coerced; rows where either is null go. Raises if a column is missing.

    keep: further columns wanted; strict readers name all, lenient ones those that are there.
    """
    from riskspark.functions.numeric import clip

    missing = [c for c in ("target", "y_prob", *(keep or [])) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    p = col("y_prob").try_cast("double")
    p = F.when(~F.isnan(p), p)
    out = df.select(*[col(c) for c in keep or []], col("target").try_cast("int").alias("target"), (clip(p, 0.0, 1.0) if clip_scores else p).alias("y_prob"))
    return out.dropna(subset=["target", "y_prob", *(keep or [])] if not clip_scores else ["target", "y_prob"])


def score_counts(df: DataFrame, keys: list[str] | None = None, y: str = "target", p: str = "y_prob") -> DataFrame:
    """(keys, score, pos, neg): what every ranking metric needs, one row a distinct score."""
    one = (col(y) == 1).cast("long")
    return df.groupBy(*(keys or []), col(p).alias("score")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))


def ranking_metrics(df: DataFrame, keys: list[str] | None = None, y: str = "target", p: str = "y_prob") -> DataFrame:
    """n, pos_rate, roc_auc (ties count half), pr_auc (step sum over distinct scores) and ks; the last three are null
    where only one class is there."""
    keys = keys or []
    c = cumulate(score_counts(df, keys, y, p), "score", ["pos", "neg"], keys)
    P, N = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    tp, fp = P - F.col("cum_pos") + F.col("pos"), N - F.col("cum_neg") + F.col("neg")
    above = P - F.col("cum_pos")
    terms = c.select(
        *keys, "pos", "neg", "all_pos", "all_neg",
        (F.col("neg") * (above + F.col("pos") / F.lit(2.0))).alias("u"),
        (F.col("pos") * tp / (tp + fp)).alias("a"),
        F.abs(ratio(tp, P) - ratio(fp, N)).alias("k"),
    )
    g = terms.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.max("all_pos").alias("ones"), F.max("all_neg").alias("zeros"), F.sum("u").alias("u"), F.sum("a").alias("a"), F.max("k").alias("k"))
    both = (F.col("ones") > 0) & (F.col("zeros") > 0)
    return g.select(*keys, "n", ratio(F.col("ones"), F.col("n")).alias("pos_rate"), F.when(both, ratio(F.col("a"), F.col("ones"))).alias("pr_auc"), F.when(both, F.col("u") / (F.col("ones").cast("double") * F.col("zeros"))).alias("roc_auc"), F.when(both, F.col("k")).alias("ks"))


def reliability(df: DataFrame, bins: int = 20, keys: list[str] | None = None, y: str = "target", p: str = "y_prob") -> DataFrame:
    """(keys, bin, mean_p, mean_y, n) of the bins that are not empty."""
    b = df.select(*(keys or []), score_bin(col(p), bins).alias("bin"), col(p).alias("p"), col(y).alias("y"))
    return b.groupBy(*(keys or []), "bin").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def calibration_error(df: DataFrame, bins: int = 20, keys: list[str] | None = None, y: str = "target", p: str = "y_prob") -> DataFrame:
    """(keys, brier, ece): the mean squared error, and the bins' gaps weighted by their share of all rows. A bin beyond
    the last edge counts in the total alone."""
    keys = keys or []
    b = df.select(*keys, score_bin(col(p), bins).alias("bin"), col(p).alias("p"), col(y).cast("double").alias("y"))
    g = b.groupBy(*keys, "bin").agg(F.avg("p").alias("mp"), F.avg("y").alias("my"), F.count("*").alias("c"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("e"))
    gap = F.when(F.col("bin") <= bins, F.col("c") * F.abs(F.col("my") - F.col("mp"))).otherwise(0.0)
    return g.groupBy(*keys).agg((F.sum("e") / F.sum("c")).alias("brier"), (F.sum(gap) / F.sum("c")).alias("ece"))


def summary(df: DataFrame, keys: list[str] | None = None, y: str = "target", p: str = "y_prob", bins: int = 20) -> DataFrame:
    """One row a group: n, positive rate, ranking metrics, Brier score and calibration error."""
    keys = keys or []
    return on(ranking_metrics(df, keys, y, p), calibration_error(df, bins, keys, y, p), keys)


def prediction_shift(df: DataFrame, raw: str = "y_prob", new: str = "y_prob_cal", q: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(q, raw, cal, diff, corr, mean_abs): exact quantiles of two scores, their correlation and mean difference."""
    row = df.agg(F.corr(raw, new).alias("corr"), F.avg(F.abs(F.col(new) - F.col(raw))).alias("mean_abs"))
    for name, x in (("a", raw), ("b", new)):
        row = on(row, quantiles(df, x, list(q)).withColumnRenamed("q", name), [])
    each = row.select("corr", "mean_abs", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in q]).alias("q"), F.col("a"), F.col("b"))).alias("z"))
    return each.select(F.col("z.q").alias("q"), F.col("z.a").alias("raw"), F.col("z.b").alias("cal"), (F.col("z.b") - F.col("z.a")).alias("diff"), "corr", "mean_abs")


def weekly_raw_and_calibrated(raw: DataFrame, cal: DataFrame, week: str = "WEEK_NUM") -> DataFrame:
    """The weekly metrics of two scores side by side; a week that one side lacks stays, with nulls."""
    left = raw.select(col(week).alias("__a"), *[col(c).alias(f"{c}_raw") for c in raw.columns if c != week])
    right = cal.select(col(week).alias("__b"), *[col(c).alias(f"{c}_cal") for c in cal.columns if c != week])
    joined = left.join(right, F.col("__a") == F.col("__b"), "full_outer")
    return joined.select(F.coalesce("__a", "__b").alias(week), *[col(c) for c in (*left.columns, *right.columns) if not c.startswith("__")])
