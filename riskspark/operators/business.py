"""Approval curves, lift, thresholds under a cap on the bad rate, and their stability over weeks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.bins import left_closed
from riskspark.functions.numeric import ratio
from riskspark.functions.schema import col

from .drift import EPS, psi
from .metrics import score_counts
from .ranks import cumulate, on, quantiles, ranked


def base_bad_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("target").alias("base_bad_rate"))


def threshold_curve(df: DataFrame, points: int = 201) -> DataFrame:
    """(threshold, approval_rate, bad_rate_in_approved, n_approved) on a grid over [0, 1]; approved means score <= t.

    Each row falls to the first grid point at or above its score; the curve is a running sum over the grid.
    """
    step = 1.0 / (points - 1)
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"), (F.col("id") * F.lit(step)).alias("threshold"))
    guess = F.ceil(col("y_prob") / F.lit(step)).cast("int")
    first = F.when((guess - 1) * F.lit(step) >= col("y_prob"), guess - 1).when(guess * F.lit(step) >= col("y_prob"), guess).otherwise(guess + 1)
    hits = df.groupBy(F.greatest(F.lit(0), first).alias("i")).agg(F.count("*").alias("n"), F.sum("target").alias("bad"))
    full = grid.join(hits, "i", "full_outer").select("i", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    w = Window.orderBy("i")  # a row a grid point
    cum = full.select("threshold", F.sum("n").over(w).alias("n_approved"), F.sum("bad").over(w).alias("b"), F.sum("n").over(Window.partitionBy()).alias("t")).where("threshold is not null")
    return cum.select("threshold", ratio(F.col("n_approved"), F.col("t")).alias("approval_rate"), ratio(F.col("b"), F.col("n_approved")).alias("bad_rate_in_approved"), "n_approved")


def _ranked(df: DataFrame, tie: str) -> DataFrame:
    """(rank, n, target) by falling score, ties by the key."""
    return ranked(df.select("target", "y_prob", col(tie).alias("__tie")), ["y_prob", "__tie"], descending=True)


def precision_at(df: DataFrame, shares: tuple[float, ...] = (0.05, 0.10, 0.15), tie: str = "case_id") -> DataFrame:
    """(k, top_n, precision_at_k, recall_at_k) of the highest floor(n * k) scores, one at least."""
    r = _ranked(df, tie)
    ks = F.explode(F.array(*[F.lit(k) for k in shares]))
    top = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("k"))).cast("long")
    x = r.select("*", ks.alias("k")).withColumn("top", top)
    inside = F.col("rank") <= F.col("top")
    g = x.groupBy("k").agg(F.max("top").alias("top_n"), F.sum(F.when(inside, F.col("target"))).alias("hit"), F.sum("target").alias("pos"))
    return g.select("k", "top_n", ratio(F.col("hit"), F.col("top_n")).alias("precision_at_k"), ratio(F.col("hit"), F.col("pos")).alias("recall_at_k"))


def lift_curve(df: DataFrame, bins: int = 20, tie: str = "case_id") -> DataFrame:
    """(bin_idx, cum_n, cum_recall, lift) over equal slices of the rows by falling score, remainders to the first."""
    r = _ranked(df, tie)
    n = F.col("n")
    q, rest = F.floor(n / bins).cast("long"), n % bins
    i = F.col("rank") - 1
    wide = rest * (q + 1)
    b = F.when(i < wide, F.floor(i / (q + 1))).otherwise(rest + F.floor((i - wide) / F.greatest(q, F.lit(1))))
    g = r.groupBy((b + 1).cast("int").alias("bin_idx")).agg(F.count("*").alias("c"), F.sum("target").alias("p"))
    w, whole = Window.orderBy("bin_idx"), Window.partitionBy()  # a row a bin
    g = g.select("bin_idx", F.sum("c").over(w).alias("cum_n"), F.sum("p").over(w).alias("cp"), F.sum("c").over(whole).alias("t"), F.sum("p").over(whole).alias("P"))
    return g.select("bin_idx", "cum_n", ratio(F.col("cp"), F.col("P")).alias("cum_recall"), (ratio(F.col("cp"), F.col("cum_n")) / ratio(F.col("P"), F.col("t"))).alias("lift"))


def threshold_under_cap(df: DataFrame, caps: tuple[float, ...] = (0.016, 0.018, 0.020)) -> DataFrame:
    """(bad_cap, threshold, approve_rate, bad_rate): the longest run of lowest scores whose bad rate is within the cap.

    Rows of one score come and go together, so the result does not hang on how ties are put; caps that no run meets give
    no row.
    """
    c = cumulate(score_counts(df), "score", ["pos", "neg"])
    k = F.col("cum_pos") + F.col("cum_neg")
    c = c.select("score", k.alias("k"), ratio(F.col("cum_pos"), k).alias("bad_rate"), (F.col("all_pos") + F.col("all_neg")).alias("t"))
    x = c.select("*", F.explode(F.array(*[F.lit(x) for x in caps])).alias("bad_cap")).where(F.col("bad_rate") <= F.col("bad_cap"))
    best = x.groupBy("bad_cap").agg(F.max(F.struct("score", "k", "bad_rate", "t")).alias("b"))
    return best.select("bad_cap", F.col("b.score").alias("threshold"), ratio(F.col("b.k"), F.col("b.t")).alias("approve_rate"), F.col("b.bad_rate").alias("bad_rate"))


def weekly_stability(df: DataFrame, threshold: float, base: DataFrame | None = None, edges: list[float] | None = None, week: str = "WEEK_NUM", least: int = 30) -> DataFrame:
    """(week, n, approve_rate, bad_rate_in_approved, bad_capture_rate, psi): one grouped pass, and PSI of the approved
    against base. Rates without a denominator are null, as is PSI under `least` approved rows."""
    ok = col("y_prob") <= threshold
    g = df.groupBy(week).agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("approve_rate"), F.avg(F.when(ok, F.col("target"))).alias("bad_rate_in_approved"), ratio(F.sum(F.when(~ok, F.col("target")).otherwise(0)), F.sum("target")).alias("bad_capture_rate"))
    if base is None:
        return g.withColumn("psi", F.lit(None).cast("double"))
    p = psi(base, df.where(ok), "y_prob", edges=edges, keys=[week], least=least).select(week, "psi")
    return on(g, p, [week], "left")


def strategy_table(val: DataFrame, test: DataFrame, caps: tuple[float, ...] = (0.016, 0.018, 0.020), week: str = "WEEK_NUM", least: int = 30, bins: int = 10) -> DataFrame:
    """A row a cap that validation can meet: the threshold, what it approves on validation and test, how often and how far
    weeks go over the cap, and drift of the approved against validation's.

    Each row meets each cap once, in one pass that counts by cap, split, week and bin of the approved scores; the rest is
    arithmetic on those counts (caps x 2 x weeks x bins of them), done on the driver.
    """
    found = threshold_under_cap(val, caps).orderBy("bad_cap").collect()  # a row a cap
    spark = val.sparkSession
    rates = ["approve_rate double", "bad_rate_in_approved double", "approved_n long", "bad_capture_rate double", "share_weeks_over_cap double", "worst_week_bad double", "std_bad double"]
    schema = ", ".join(["bad_cap double", "threshold double", *[f"{s}_{r}" for s in ("val", "test") for r in rates], "test_median_week_psi double", "test_max_week_psi double", "test_overall_psi double"])
    if not found:
        return spark.createDataFrame([], schema)
    both = val.select(F.lit(0).alias("s"), col(week).alias("week"), "target", "y_prob").unionAll(test.select(F.lit(1), col(week), "target", "y_prob"))
    met = both.withColumn("cap", F.explode(F.array(*[F.struct(F.lit(f.bad_cap).alias("cap"), F.lit(f.threshold).alias("t")) for f in found]))).select("s", "week", "target", "y_prob", "cap.cap", (F.col("y_prob") <= F.col("cap.t")).alias("ok"))
    edges = {r.cap: list(r.q) for r in quantiles(met.where("s = 0 and ok"), "y_prob", [i / bins for i in range(1, bins)], ["cap"]).collect()}
    cut = F.create_map(*[x for f in found for x in (F.lit(f.bad_cap), F.array(*[F.lit(e) for e in edges[f.bad_cap]]))])
    binned = met.withColumn("bin", F.when(F.col("ok"), left_closed(F.col("y_prob"), cut[F.col("cap")])).otherwise(-1))
    counts = binned.groupBy("cap", "s", "week", "bin").agg(F.count("*").alias("n"), F.sum("target").alias("bad")).toPandas()
    out = []
    for f in found:
        row: list = [f.bad_cap, f.threshold]
        mine = counts[counts.cap == f.bad_cap]
        for s in (0, 1):
            row += _approved(mine[mine.s == s], f.bad_cap)
        ok = mine[mine.bin >= 0]
        grid = lambda d: np.bincount(d.bin.to_numpy(int), d.n.to_numpy(float), bins)
        base, seen = grid(ok[ok.s == 0]), ok[ok.s == 1]
        psis = [_psi(base, grid(d)) for _, d in seen.groupby("week") if d.n.sum() >= least]
        row += [float(np.median(psis)) if psis else None, max(psis, default=None), _psi(base, grid(seen)) if len(seen) else None]
        out.append(row)
    return spark.createDataFrame(out, schema)


def _approved(counts: pd.DataFrame, cap: float) -> list:
    """Of one cap and split's counts by week and bin (-1: not approved): the rates over all rows and over weeks."""
    ok = counts.bin >= 0
    n, bad, n_ok, bad_ok = counts.n.sum(), counts.bad.sum(), counts.n[ok].sum(), counts.bad[ok].sum()
    share = lambda a, b: float(a) / float(b) if b else None
    weeks = counts[ok].groupby("week")[["n", "bad"]].sum()
    rate = (weeks.bad / weeks.n).to_numpy(float)
    total = counts.week.nunique()
    return [share(n_ok, n), share(bad_ok, n_ok), int(n_ok), share(bad - bad_ok, max(1, bad)), share((rate > cap).sum(), total), float(rate.max()) if len(rate) else None, float(rate.std()) if len(rate) else None]


def _psi(base: np.ndarray, other: np.ndarray) -> float:
    e, a = base / max(1.0, base.sum()), other / max(1.0, other.sum())
    return float(((a - e) * np.log((a + EPS) / (e + EPS))).sum())
