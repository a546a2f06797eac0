"""Logistic regression by follow-the-regularised-leader updates (McMahan et al., 2013) on sparse hashed features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, tidied


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-3
    epochs: int = 4


@dataclass(frozen=True)
class Linear:
    """Weights by feature; the last one is the bias."""

    weights: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray | float) -> float:
        z = float((self.weights[at] * value).sum(dtype=np.float64)) + float(self.weights[-1])
        return 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, z))))


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, float]], size: int, p: Ftrl) -> np.ndarray:
    """rows: (features, values, label from 0 to 1), in the order in which each epoch takes them; gone through once an epoch."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])
    for _ in range(p.epochs):
        for at, value, y in rows:
            at, x = np.concatenate([at, bias]), np.concatenate([value, [1.0]])
            zi, ni = z[at], n[at]
            w = -np.sign(zi) * np.maximum(np.abs(zi) - p.l1, 0) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
            prob = 1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (prob - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - p.l1, 0) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return w.astype(np.float32)


def train(features: DataFrame, size: int, p: Ftrl) -> Linear:
    """features (place long, at array<int>, value array<float>, y double): a bounded sample. One task learns from it.

    Rows are taken by place, of which each has its own, so the result does not depend on how they are stored. No rows
    give weights of zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), (np.array(x.as_py(), np.int64) for x in b.column(1)), (np.array(x.as_py(), np.float64) for x in b.column(2)), b.column(3).to_pylist())
        rows.sort(key=lambda r: r[0])
        w = fit([r[1:] for r in rows], size, p)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    found = features.select("place", "at", "value", "y").repartition(1).mapInArrow(tidied(run), "w binary").collect()
    return Linear(np.frombuffer(bytes(found[0].w), np.float32) if found else np.zeros(size + 1, np.float32))


def sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y, place) of at most `bound` labelled rows outside the held-out fold: those with the least hash of the id.

    A doc_id with several labels takes the largest; rows with a null id or label are passed over.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("doc_id"))
    return known.orderBy("place", "doc_id").limit(bound)
