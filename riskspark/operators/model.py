"""Gradient-boosted trees: training, search over expanding folds, scoring, and exact contributions of features."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.bins import right_closed, unique_edges
from riskspark.functions.numeric import finite
from riskspark.functions.schema import col

from .conformal import density_ratio
from .calibrate import probability
from .metrics import ranking_metrics
from .ranks import on, quantiles
from .prepare import fold_frames

SEED = 42


def balance(df: DataFrame, y: str = "target") -> float:
    """What a positive row weighs against a negative one; 1 at least."""
    r = df.agg(F.sum((col(y) == 1).cast("long")).alias("p"), F.sum((col(y) == 0).cast("long")).alias("n")).first()
    return max(1.0, (r.n or 0) / max(1, r.p or 0))


def align(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The kept columns that are there, then the model's features in the model's order; raises if one is missing."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(*[col(k) for k in (df.columns if keep is None else keep) if k in df.columns and k not in features], *[col(f) for f in features])


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    known = [finite(col(f)).alias(f"__f{i}") for i, f in enumerate(features)]
    rows = align(df, features).select("*", *known)
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="features").transform(rows).drop(*[f"__f{i}" for i in range(len(features))])


@dataclass(frozen=True)
class Boosted:
    model: GBTClassificationModel
    features: list[str]

    @staticmethod
    def fit(df: DataFrame, features: list[str], y: str = "target", rounds: int = 20, depth: int = 4, rate: float = 0.1, subsample: float = 1.0, least: int = 1, gain: float = 0.0, bins: int = 32, columns: str = "all", share: float = 0.0, tolerance: float = 0.01, positive: float = 1.0, val: DataFrame | None = None) -> Boosted:
        """Positive rows weigh balance(df), to the power of `positive`; nulls are 0. With `val`, boosting stops when these
        rows' loss no longer falls by `tolerance`."""
        weight = F.when(F.col("label") == 1, F.lit(balance(df, y) ** positive)).otherwise(1.0)
        made = lambda d, held: _vectors(d, features).select("features", col(y).cast("double").alias("label"), F.lit(held).alias("held")).withColumn("w", weight)
        x = made(df, False) if val is None else made(df, False).unionAll(made(val, True))
        stop = {} if val is None else {"validationIndicatorCol": "held", "validationTol": tolerance}
        gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, minInstancesPerNode=least, minInfoGain=gain, maxBins=bins, featureSubsetStrategy=columns, minWeightFractionPerNode=share, weightCol="w", seed=SEED, **stop)
        return Boosted(gbt.fit(x), features)

    def predict(self, df: DataFrame, keep: list[str] = ["case_id", "WEEK_NUM", "target"]) -> DataFrame:
        """The kept columns and y_prob."""
        return self.model.transform(_vectors(df, self.features)).select(*[col(k) for k in keep if k in df.columns], probability().alias("y_prob"))

    def gain(self, spark) -> DataFrame:
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, self.model.featureImportances.toArray())], "feature string, gain double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(i, f) for i, f in enumerate(self.features)], "i int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark, path: str) -> Boosted:
        names = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("i").collect()]
        return Boosted(GBTClassificationModel.load(f"{path}/model"), names)

    def leaves(self) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
        """Each leaf's weighted value and, by feature on its path, the interval that leads there and the share of the
        training rows that the feature's splits let through."""
        out = []

        def walk(node, scale: float, path: dict[int, tuple[float, float, float]]) -> None:
            if node.getClass().getSimpleName() == "LeafNode":
                out.append((scale * node.prediction(), [(f, *v) for f, v in sorted(path.items())]))
                return
            split = node.split()
            f, t = split.featureIndex(), split.threshold()
            total = node.impurityStats().count()
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
                share *= child.impurityStats().count() / total if total else 0.5
                walk(child, scale, path | {f: (low, min(high, t), share) if left else (max(low, t), high, share)})

        for tree, weight in zip(self.model.trees, self.model.treeWeights):
            walk(tree._java_obj.rootNode(), float(weight), {})
        return out

    def contributions(self, df: DataFrame, keep: list[str] = ["case_id", "WEEK_NUM"]) -> DataFrame:
        """The kept columns and, by feature, its exact contribution to the margin (path-dependent Shapley values).

        A leaf pays its value if all features on its path let a row through; a feature not in a coalition lets through
        its share. The coalitions of one size are summed as a coefficient of the product of (share + t * lets through)
        over the path's other features, so that a path of m features takes m cubed steps, for all rows of a batch at once.
        """
        leaves, k = self.leaves(), len(self.features)
        names = list(self.features)
        have = [c for c in keep if c in df.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([np.nan_to_num(b.column(len(have) + i).to_numpy(zero_copy_only=False).astype(float)) for i in range(k)])
                phi = np.zeros((len(x), k))
                for value, path in leaves:
                    m = len(path)
                    one = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in path]
                    zero = [s for *_, s in path]
                    pays = [math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m) for size in range(m)]
                    for i in range(m):
                        sums = np.zeros((m, len(x)))  # by size of the coalition
                        sums[0] = 1.0
                        for n, j in enumerate(j for j in range(m) if j != i):
                            sums[1 : n + 2] = sums[1 : n + 2] * zero[j] + sums[: n + 1] * one[j]
                            sums[0] *= zero[j]
                        phi[:, path[i][0]] += value * (pays @ sums) * (one[i] - zero[i])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(have)], *[pa.array(phi[:, i]) for i in range(k)]], [*have, *names])

        rows = align(df, names).select(*[col(c) for c in have], *[finite(col(f)).alias(f"__f{i}") for i, f in enumerate(names)])
        from pyspark.sql import types as T

        schema = T.StructType([df.schema[c] for c in have] + [T.StructField(f, T.DoubleType()) for f in names])
        return rows.mapInArrow(run, schema)


def mean_abs(shap: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, shap): the mean absolute contribution, overall or by group."""
    g = shap.groupBy(*(keys or [])).agg(*[F.avg(F.abs(col(f))).alias(f"__{i}") for i, f in enumerate(features)])
    return g.select(*(keys or []), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__{i}").alias("shap")) for i, f in enumerate(features)])))


def dependence(base: DataFrame, other: DataFrame, x: str, s: str, bins: int = 10, least: int = 30) -> DataFrame:
    """(bin, n_base, mean_x_base, mean_s_base, n_other, ...): contributions by bins of a feature, the edges from base's
    quantiles and 0. Bins need `least` rows on both sides; if none has, on either."""
    e = quantiles(base, x, [i / bins for i in range(bins + 1)]).select(unique_edges(F.col("q")).alias("e")).first()
    e = [v for v in (e.e if e else None) or [] if v is not None]
    edges = e[1:-1] if len(e) > 2 else []
    part = lambda d, n: d.where(col(x).isNotNull()).groupBy(right_closed(col(x), edges).alias("bin")).agg(F.count("*").alias(f"n_{n}"), F.avg(x).alias(f"mean_x_{n}"), F.avg(s).alias(f"mean_s_{n}"))
    j = part(base, "base").join(part(other, "other"), "bin", "full_outer")
    a, b = F.coalesce("n_base", F.lit(0)) >= least, F.coalesce("n_other", F.lit(0)) >= least
    from pyspark.sql import Window

    return j.withColumn("__any", F.max((a & b).cast("int")).over(Window.partitionBy())).where(F.when(F.col("__any") == 1, a & b).otherwise(a | b)).drop("__any")


def category_dependence(base: DataFrame, other: DataFrame, x: str, s: str, least: int = 30) -> DataFrame:
    """(level, code, n_base, mean_s_base, n_other, mean_s_other): contributions by level of a categorical feature; levels
    with `least` rows on either side stay."""
    part = lambda d, n: d.where(col(x).isNotNull()).groupBy(col(x).alias("level")).agg(F.count("*").alias(f"n_{n}"), F.avg(s).alias(f"mean_s_{n}"))
    j = category_codes(base, other, x).join(part(base, "base"), "level", "left").join(part(other, "other"), "level", "left")
    return j.where((F.coalesce("n_base", F.lit(0)) >= least) | (F.coalesce("n_other", F.lit(0)) >= least))


def category_codes(base: DataFrame, other: DataFrame, x: str) -> DataFrame:
    """(level, code): levels of both sides in order, from 0."""
    from pyspark.sql import Window

    both = base.select(col(x).alias("level")).union(other.select(col(x).alias("level"))).where("level is not null").distinct()
    return both.select("level", (F.dense_rank().over(Window.orderBy("level")) - 1).alias("code"))


#: The search space: a value is drawn for each name.
SPACE = {
    "depth": (3, 4, 5, 6), "rate": (0.02, 0.05, 0.1, 0.2), "subsample": (0.6, 0.7, 0.85, 1.0), "least": (1, 10, 50, 200), "gain": (0.0, 1e-4, 1e-3),
    "bins": (32, 64, 128), "columns": ("all", "0.8", "0.5", "sqrt"), "share": (0.0, 0.001, 0.01), "tolerance": (0.0, 0.001, 0.01), "positive": (1.0, 0.5),
}


def propose(tried: list[tuple[dict, float]], draw: random.Random, warm: int = 10, candidates: int = 24) -> dict:
    """The next trial, by a tree of Parzen estimators over the discrete space (Bergstra et al., 2011): after `warm` random
    ones, of some candidates drawn by how often the best quarter of trials took each value, the one that is likeliest
    among these against the rest."""
    if len(tried) < warm:
        return {k: draw.choice(v) for k, v in SPACE.items()}
    ranked_ = sorted(tried, key=lambda t: -t[1])
    cut = max(1, len(ranked_) // 4)
    count = lambda some, k: [1.0 + sum(p[k] == v for p, _ in some) for v in SPACE[k]]
    good, bad = ({k: count(part, k) for k in SPACE} for part in (ranked_[:cut], ranked_[cut:]))
    pool = [{k: draw.choices(v, good[k])[0] for k, v in SPACE.items()} for _ in range(candidates)]
    score = lambda p: sum(math.log(good[k][SPACE[k].index(v)] / sum(good[k])) - math.log(bad[k][SPACE[k].index(v)] / sum(bad[k])) for k, v in p.items())
    return max(pool, key=score)


def search(df: DataFrame, features: list[str], folds: list[tuple[int, int, int]], trials: int = 100, rounds: int = 3000, seed: int = SEED) -> tuple[dict, float, int]:
    """(parameters, mean average precision over expanding folds, best number of rounds on the last fold) of the best
    trial. A fold's boosting stops early on its own validation rows. Fold models are fitted one after the other; each
    fit is distributed."""
    draw, tried, best = random.Random(seed), [], ({}, -1.0, 1)
    for _ in range(trials):
        params, scores, last = propose(tried, draw), [], 1
        for fold in folds:
            train, val = fold_frames(df, fold)
            m = Boosted.fit(train, features, rounds=rounds, val=val, **params)
            last = best_rounds(m, val)
            scores.append(ranking_metrics(m.predict(val)).first().pr_auc or 0.0)
        mean = sum(scores) / max(1, len(scores))
        tried.append((params, mean))
        if mean > best[1]:
            best = params, mean, last
    return best


def retrain(df: DataFrame, features: list[str], params: dict, best: int, low: int = 100, high: int = 6000) -> Boosted:
    """The final model on all training rows, a little longer than the last fold's best."""
    return Boosted.fit(df, features, rounds=final_rounds(best, low, high), **params)


def best_rounds(model: Boosted, val: DataFrame) -> int:
    """The number of trees with the least validation loss."""
    x = _vectors(val, model.features).select("features", col("target").cast("double").alias("label"), F.lit(1.0).alias("w"))
    losses = model.model.evaluateEachIteration(x)
    return int(np.argmin(losses)) + 1


def final_rounds(best: int, low: int = 100, high: int = 6000) -> int:
    return max(low, min(high, math.ceil(1.1 * best)))


def weekly_domain_weights(df: DataFrame, features: list[str], first_week: int, window: int = 6, week: str = "WEEK_NUM", cap: float = 0.99) -> DataFrame:
    """df's rows under each target week (`wk`) that they calibrate, with `w`: how much likelier they are in that week.

    A domain model is fitted for each week from the `window` weeks before it, one after the other.
    """
    out = None
    for r in df.where(col(week) >= first_week).select(col(week).alias("wk")).distinct().orderBy("wk").collect():
        cal = df.where(col(week).between(r.wk - window, r.wk - 1))
        if cal.isEmpty():
            continue
        part = domain_weights(cal, df.where(col(week) == r.wk), features, cap).withColumn("wk", F.lit(r.wk))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("w", F.lit(0.0)).withColumn("wk", F.lit(0).cast("bigint"))


def domain_weights(cal: DataFrame, target: DataFrame, features: list[str], cap: float = 0.99) -> DataFrame:
    """cal with `w`: how much likelier its rows are under target's distribution, by a logistic domain classifier."""
    rows = cal.select(*[col(f) for f in features]).withColumn("label", F.lit(0.0)).unionByName(target.select(*[col(f) for f in features]).withColumn("label", F.lit(1.0)))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    m = LogisticRegression(maxIter=50, regParam=1e-3).fit(_vectors(rows, features).select("features", "label"))
    g = m.transform(_vectors(cal, features)).withColumn("g", probability()).drop("features", "rawPrediction", "probability", "prediction")
    return density_ratio(g, "g", counts.get(0.0, 0), counts.get(1.0, 0), cap).drop("g")


def weight_summary(w: DataFrame) -> DataFrame:
    q = quantiles(w, "w", [0.95, 0.99]).select(F.col("q")[0].alias("w_p95"), F.col("q")[1].alias("w_p99"))
    return on(w.agg(F.avg("w").alias("w_mean"), F.max("w").alias("w_cap")), q, []).select("w_mean", "w_p95", "w_p99", "w_cap")


@dataclass(frozen=True)
class GainShapSelector:
    """The features kept, in order of name."""

    features: tuple[str, ...]

    @staticmethod
    def fit(df: DataFrame, features: list[str], k_gain: int = 276, k_shap: int = 201, rounds: int = 10) -> GainShapSelector:
        from .select import union_of_tops

        m = Boosted.fit(df, features, rounds=rounds)
        shap = mean_abs(m.contributions(df, []), features)
        return GainShapSelector(tuple(r.feature for r in union_of_tops(m.gain(df.sparkSession), shap, k_gain, k_shap).collect()))

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ("case_id", "WEEK_NUM", "target")) -> DataFrame:
        return align(df, list(self.features)).select(*[col(k) for k in keep if k in df.columns], *[col(f) for f in self.features])
