"""What the operators on embeddings share: which vectors take part, and their bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(vectors: DataFrame) -> tuple[DataFrame, Column]:
    """(vec_id, v array<double>), and whether a row takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0.0)
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))
    return rows, good


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part: a vec_id, and a vector without null or non-finite
    components that is not zero."""
    rows, good = _rows(vectors)
    return rows.where(good).withColumn("dim", F.size("v"))


def unusable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of all other rows."""
    rows, good = _rows(vectors)
    return rows.where(~good)


def matrix(column, dim: int) -> np.ndarray:
    """Vectors stored as bytes of doubles, as rows."""
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. They are scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
