"""Stability of distributions and information value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.bins import left_closed, right_closed
from riskspark.functions.numeric import ratio
from riskspark.functions.schema import col

from .ranks import cumulate, on, quantiles, ranked
from .select import stacked

EPS = 1e-6


def quantile_edges(df: DataFrame, x: str, bins: int) -> list[float]:
    """Fitted state: the bins - 1 exact inner quantiles; empty where x has no values."""
    found = quantiles(df, x, [i / bins for i in range(1, bins)]).first() if bins > 1 else None
    return list(found.q) if found and found.q else []


def spine(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


def psi_bins(base: DataFrame, other: DataFrame, x: str, bins: int = 10, edges: list[float] | None = None, eps: float = EPS, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, exp_rate, act_rate, contrib) of every bin, empty ones too. Edges are base's quantiles unless given,
    and then their number rules. keys group `other`; each group is compared with the same base."""
    keys = keys or []
    e = quantile_edges(base, x, bins) if edges is None else edges
    bin_ = left_closed(col(x), e).alias("bin")
    want = base.where(col(x).isNotNull()).groupBy(bin_).agg(F.count("*").alias("a"))
    have = other.where(col(x).isNotNull()).groupBy(*keys, bin_).agg(F.count("*").alias("b"))
    bins_ = F.broadcast(spine(base, len(e) + 1))
    want = bins_.join(want, "bin", "left").select("bin", ratio(F.coalesce("a", F.lit(0)), F.greatest(F.lit(1), F.sum("a").over(Window.partitionBy()))).alias("exp_rate"))
    groups = have.groupBy(*keys).agg(F.sum("b").alias("t")) if keys else have.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("t"))
    full = on(groups.join(F.broadcast(want), how="cross"), have, [*keys, "bin"], "left")  # want: a row a bin
    act = ratio(F.coalesce("b", F.lit(0)), F.greatest(F.lit(1), F.col("t")))
    out = full.select(*keys, "bin", F.coalesce("exp_rate", F.lit(0.0)).alias("exp_rate"), act.alias("act_rate"), F.col("t").alias("n"))
    return out.withColumn("contrib", (F.col("act_rate") - F.col("exp_rate")) * F.ln((F.col("act_rate") + eps) / (F.col("exp_rate") + eps)))


def psi(base: DataFrame, other: DataFrame, x: str, bins: int = 10, edges: list[float] | None = None, keys: list[str] | None = None, least: int = 0) -> DataFrame:
    """(keys, n, psi); null for groups of fewer than `least` rows."""
    b = psi_bins(base, other, x, bins, edges, keys=keys)
    return b.groupBy(*(keys or [])).agg(F.max("n").alias("n"), F.sum("contrib").alias("psi")).withColumn("psi", F.when(F.col("n") >= least, F.col("psi")))


def psi_categorical(base: DataFrame, other: DataFrame, x: str, eps: float = EPS) -> DataFrame:
    """(psi): over base's levels alone; other levels are ignored and rates are taken among those kept."""
    a = base.where(col(x).isNotNull()).groupBy(col(x).alias("level")).agg(F.count("*").alias("a"))
    b = other.where(col(x).isNotNull()).groupBy(col(x).alias("level")).agg(F.count("*").alias("b"))
    j = a.join(b, "level", "left").select("a", F.coalesce("b", F.lit(0)).alias("b"))
    t = j.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    r = j.join(F.broadcast(t), how="cross").select(ratio(F.col("a"), F.greatest(F.lit(1), F.col("ta"))).alias("e"), ratio(F.col("b"), F.greatest(F.lit(1), F.col("tb"))).alias("c"))
    return r.agg(F.sum((F.col("c") - F.col("e")) * F.ln((F.col("c") + eps) / (F.col("e") + eps))).alias("psi"))


def weekly_psi(base: DataFrame, other: DataFrame, x: str = "y_prob", week: str = "WEEK_NUM", bins: int = 20, least: int = 30) -> DataFrame:
    """(week, n, psi) against base's edges."""
    return psi(base, other, x, bins, keys=[week], least=least)


def feature_edges(base: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(feature, e): the inner quantiles of every feature, all in one pass. A row a feature."""
    return quantiles(stacked(base, features), "x", [i / bins for i in range(1, bins)], ["feature"]).withColumnRenamed("q", "e")


def _psi_terms(act: Column, exp: Column, eps: float = EPS) -> Column:
    return (act - exp) * F.ln((act + eps) / (exp + eps))


def _share(df: DataFrame, n: str, keys: list[str], name: str) -> DataFrame:
    """df, a row a bin, with `name`, n's share among the rows of one key (0 where they have none)."""
    return df.withColumn(name, ratio(F.col(n), F.greatest(F.lit(1), F.sum(n).over(Window.partitionBy(*keys)))))


def weekly_feature_psi(base: DataFrame, other: DataFrame, features: list[str], week: str = "WEEK_NUM", bins: int = 10, least: int = 30) -> DataFrame:
    """(feature, week, n, psi) of each feature. Features are stacked, so that their number adds no pass over the data."""
    edges = F.broadcast(feature_edges(base, features, bins))  # a row a feature
    count = lambda df, keys, n: stacked(df, features, keys).where("x is not null").join(edges, "feature").groupBy("feature", *keys, left_closed(F.col("x"), F.col("e")).alias("bin")).agg(F.count("*").alias(n))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    want = _share(grid.join(count(base, [], "a"), ["feature", "bin"], "left").na.fill(0, ["a"]), "a", ["feature"], "exp")
    have = count(other, [week], "b")
    groups = have.groupBy("feature", week).agg(F.sum("b").alias("n"))
    full = on(groups.join(F.broadcast(want), "feature"), have, ["feature", week, "bin"], "left")
    act = ratio(F.coalesce("b", F.lit(0)), F.greatest(F.lit(1), F.col("n")))
    out = full.groupBy("feature", week).agg(F.max("n").alias("n"), F.sum(_psi_terms(act, F.col("exp"))).alias("psi"))
    return out.withColumn("psi", F.when(F.col("n") >= least, F.col("psi")))


def psi_summary(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("feature").agg(F.median("psi").alias("median_psi"), F.max("psi").alias("max_psi"))


def ks_two_sample(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """(ks): the largest distance of the two empirical distribution functions; null where one side is empty."""
    one = lambda df, i: df.where(col(x).isNotNull()).select(col(x).cast("double").alias("v"), F.lit(i).alias("a"), F.lit(1 - i).alias("b"))
    g = one(a, 1).unionAll(one(b, 0)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    c = cumulate(g, "v", ["a", "b"])
    return c.agg(F.max(F.abs(ratio(F.col("cum_a"), F.col("all_a")) - ratio(F.col("cum_b"), F.col("all_b")))).alias("ks"))


def _woe_sum(counts: DataFrame, levels: Column, eps: float) -> DataFrame:
    """counts (good, bad, G, B): smoothed rates, and the sum of their differences times the log of their ratio."""
    g = (F.col("good") + eps) / (F.col("G") + F.lit(eps) * levels)
    b = (F.col("bad") + eps) / (F.col("B") + F.lit(eps) * levels)
    return counts.agg(F.sum((g - b) * F.ln(g / b)).alias("iv"))


def iv_numeric(df: DataFrame, x: str, edges: list[float], y: str = "target", eps: float = EPS) -> DataFrame:
    """(iv) with bins (lo, hi] at given edges; nulls are left out, empty bins count."""
    rows = df.where(col(x).isNotNull()).groupBy(right_closed(col(x), edges).alias("bin")).agg(F.sum((col(y) == 0).cast("long")).alias("good"), F.sum((col(y) == 1).cast("long")).alias("bad"))
    full = F.broadcast(spine(df, len(edges) + 1)).join(rows, "bin", "left").select(F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    w = Window.partitionBy()  # a row a bin
    return _woe_sum(full.select("good", "bad", F.sum("good").over(w).alias("G"), F.sum("bad").over(w).alias("B")), F.lit(len(edges) + 1), eps)


def iv_categorical(train: DataFrame, df: DataFrame, x: str, y: str = "target", eps: float = EPS) -> DataFrame:
    """(iv) over train's levels; totals are those of all rows of df with a value, unseen levels too."""
    levels = train.where(col(x).isNotNull()).select(col(x).alias("level")).distinct()
    known = df.where(col(x).isNotNull())
    c = known.groupBy(col(x).alias("level")).agg(F.sum((col(y) == 0).cast("long")).alias("good"), F.sum((col(y) == 1).cast("long")).alias("bad"))
    t = c.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("G"), F.coalesce(F.sum("bad"), F.lit(0)).alias("B"))
    k = levels.agg(F.count("*").alias("K"))
    full = levels.join(c, "level", "left").select(F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    return _woe_sum(full.join(F.broadcast(t), how="cross").join(F.broadcast(k), how="cross"), F.col("K"), eps)


def merge_small_bins(counts: list[tuple[object, int]], least: int) -> dict:
    """Where each bin goes: in ascending order ("MISSING" last, text after numbers), bins under `least` rows go to the
    bin before, text ones to the first; later merges move what came before along. Only if there are two bins."""
    order = sorted(counts, key=lambda c: (isinstance(c[0], str), c[0] == "MISSING", c[0]))
    place = {b: b for b, _ in order}
    if least and len(order) > 1 and min(n for _, n in order) < least:
        for b, n in order:
            if n < least:
                to = b - 1 if isinstance(b, int) and b > 0 else order[0][0]
                place = {k: to if v == b else v for k, v in place.items()}
    return place


def equal_frequency(df: DataFrame, x: str, bins: int, order: list[str]) -> DataFrame:
    """df with `bin` from 0: x ranked (ties by order), ranks cut at their own quantiles, (lo, hi]."""
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: 1.0 + (F.col("__n") - 1) * (i / F.lit(float(bins))))
    return ranked(df, [x, *order], "__at", "__n").withColumn("__e", edges).withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col("__at")))).drop("__at", "__n", "__e")


def iv_qcut(df: DataFrame, x: str, order: list[str], y: str = "target", bins: int = 10, least: int = 30, eps: float = EPS) -> float:
    """Information value with equal-frequency bins (values of few levels are bins themselves), small bins merged.

    At most bins + 1 counted rows come to the driver.
    """
    kinds = df.agg((F.count_distinct(col(x)) + F.max(col(x).isNull().cast("int"))).alias("d")).first()
    if kinds.d <= bins:
        b = F.coalesce(col(x).cast("string"), F.lit("MISSING"))
        rows = df.select(b.alias("b"), col(y).alias("y"))
    else:
        middle = quantiles(df, x, [0.5]).first()
        filled = df.select(F.coalesce(col(x), F.lit(middle.q[0] if middle and middle.q else None)).alias("v"), col(x).isNull().alias("gone"), col(y).alias("y"), *[col(o).alias(f"__o{i}") for i, o in enumerate(order)])
        cut = equal_frequency(filled, "v", bins, [f"__o{i}" for i in range(len(order))])
        rows = cut.select(F.when(F.col("gone"), "MISSING").otherwise(F.col("bin").cast("string")).alias("b"), "y")
    found = rows.groupBy("b").agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("bad"), F.sum((F.col("y") == 0).cast("long")).alias("good")).collect()
    name = (lambda s: s) if kinds.d <= bins else (lambda s: s if s == "MISSING" else int(s))
    place = merge_small_bins([(name(r.b), r.n) for r in found], least)
    total: dict = {}
    for r in found:
        g = total.setdefault(place[name(r.b)], [0, 0])
        g[0] += r.bad
        g[1] += r.good
    import math

    B, G = max(sum(g[0] for g in total.values()), eps), max(sum(g[1] for g in total.values()), eps)
    return sum((b / B - g / G) * math.log((b / B + eps) / (g / G + eps)) for b, g in total.values())


def iv_filter(df: DataFrame, columns: list[str], order: list[str], y: str = "target", least: float = 0.005) -> dict[str, float]:
    """The information value of each column that stays: those of two levels or fewer always do (nan), others from
    `least` on."""
    row = df.agg(*[(F.count_distinct(col(c)) + F.max(col(c).isNull().cast("int"))).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"d{i}"] <= 2:
            out[c] = float("nan")
        elif (iv := iv_qcut(df, c, order, y)) >= least:
            out[c] = iv
    return out


def stability_table(train: DataFrame, val: DataFrame, test: DataFrame, features: list[str], y: str = "target", bins: int = 10, eps: float = EPS) -> DataFrame:
    """A row a numeric feature: PSI, two-sample KS and IV of validation and test against training.

    All features and splits are stacked: one pass for the edges, one for the bins, one for the distributions.
    """
    names = ("train", "val", "test")
    long = None
    for i, d in enumerate((train, val, test)):
        part = stacked(d, features, [y]).where("x is not null").select("feature", "x", (col(y) == 1).cast("long").alias("bad"), (col(y) == 0).cast("long").alias("good"), F.lit(i).alias("s"))
        long = part if long is None else long.unionAll(part)
    edges = F.broadcast(feature_edges(train, features, bins))  # a row a feature
    both = long.join(edges, "feature").select("feature", "s", "bad", "good", F.explode(F.array(F.struct(F.lit(0).alias("way"), left_closed(F.col("x"), F.col("e")).alias("bin")), F.struct(F.lit(1).alias("way"), right_closed(F.col("x"), F.col("e")).alias("bin")))).alias("b"))
    counts = both.groupBy("feature", "s", F.col("b.way").alias("way"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    full = grid.join(counts, ["feature", "bin", "way", "s"], "left").na.fill(0, ["n", "bad", "good"])
    whole = ["feature", "way", "s"]
    full = _share(full, "n", whole, "r")
    smooth = lambda c: (F.col(c) + eps) / (F.sum(c).over(Window.partitionBy(*whole)) + F.lit(eps * bins))
    full = full.withColumn("g", smooth("good")).withColumn("b", smooth("bad")).withColumn("iv", (F.col("g") - F.col("b")) * F.ln(F.col("g") / F.col("b")))
    rate = full.where("way = 0").groupBy("feature", "bin").agg(*[F.max(F.when(F.col("s") == i, F.col("r"))).alias(f"r{i}") for i in range(3)])
    psis = rate.groupBy("feature").agg(*[F.sum(_psi_terms(F.col(f"r{i}"), F.col("r0"), eps)).alias(f"psi_train_to_{names[i]}") for i in (1, 2)])
    ivs = full.where("way = 1").groupBy("feature").agg(*[F.sum(F.when(F.col("s") == i, F.col("iv"))).alias(f"iv_{n}") for i, n in enumerate(names)])
    steps = cumulate(long.groupBy("feature", "x").agg(*[F.sum((F.col("s") == i).cast("long")).alias(f"c{i}") for i in range(3)]), "x", ["c0", "c1", "c2"], ["feature"])
    share = lambda i: ratio(F.col(f"cum_c{i}"), F.col(f"all_c{i}"))
    ks = steps.groupBy("feature").agg(*[F.max(F.abs(share(0) - share(i))).alias(f"ks_train_vs_{names[i]}") for i in (1, 2)])
    out = psis.join(ks, "feature").join(ivs, "feature")
    cols = ["psi_train_to_val", "psi_train_to_test", "ks_train_vs_val", "ks_train_vs_test", "iv_train", "iv_val", "iv_test"]
    return out.select("feature", *cols, (F.col("iv_val") - F.col("iv_train")).alias("iv_val_minus_train"), (F.col("iv_test") - F.col("iv_train")).alias("iv_test_minus_train"))
