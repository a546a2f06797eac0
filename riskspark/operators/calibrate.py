"""Probability calibration on pyspark.ml, and what it changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.numeric import logit
from riskspark.functions.schema import col


@dataclass(frozen=True)
class Platt:
    """Logistic regression on the clipped log-odds, with a ridge penalty of 1 on the sum of losses."""

    slope: float
    intercept: float

    @staticmethod
    def fit(df: DataFrame, y: str = "target", p: str = "y_prob") -> Platt:
        """By Newton's steps; each is one aggregation of the two coefficients' gradient and curvature."""
        z, t = logit(col(p)), col(y).cast("double")
        rows = df.select(z.alias("z"), t.alias("t")).where(F.col("z").isNotNull() & F.col("t").isNotNull()).groupBy("z").agg(F.count("*").cast("double").alias("n"), F.sum("t").alias("t")).cache()
        a = b = 0.0
        try:
            for _ in range(30):
                q = 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("z") + F.lit(b))))
                w = F.col("n") * q * (1.0 - q)
                e = F.col("n") * q - F.col("t")
                r = rows.agg(F.sum(e * F.col("z")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("z") * F.col("z")).alias("aa"), F.sum(w * F.col("z")).alias("ab"), F.sum(w).alias("bb")).first()
                if r.gb is None:
                    break
                ga, aa = r.ga + a, r.aa + 1.0
                det = aa * r.bb - r.ab * r.ab
                if det <= 0:
                    break
                da, db = (r.bb * ga - r.ab * r.gb) / det, (aa * r.gb - r.ab * ga) / det
                a, b = a - da, b - db
                if abs(da) + abs(db) < 1e-12:
                    break
        finally:
            rows.unpersist()
        return Platt(a, b)

    def transform(self, df: DataFrame, p: str = "y_prob", out: str = "y_prob_cal") -> DataFrame:
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-(logit(col(p)) * F.lit(self.slope) + F.lit(self.intercept)))))


@dataclass(frozen=True)
class Isotonic:
    """A monotone step-free fit; between its points it is linear, beyond them constant."""

    model: object

    @staticmethod
    def fit(df: DataFrame, y: str = "target", p: str = "y_prob") -> Isotonic:
        return Isotonic(IsotonicRegression(featuresCol="__x", labelCol="__y").fit(df.select(col(p).cast("double").alias("__x"), col(y).cast("double").alias("__y"))))

    def transform(self, df: DataFrame, p: str = "y_prob", out: str = "y_prob_cal") -> DataFrame:
        made = self.model.transform(df.withColumn("__x", col(p).cast("double")))
        return made.withColumnRenamed("prediction", out).drop("__x")


def probability(column: str = "probability"):
    return vector_to_array(col(column))[1]
