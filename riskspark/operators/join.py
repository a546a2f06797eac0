"""Joining features and predictions whose common key has to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ranks import ranked

#: Names that may identify a row, in order of preference.
ID_NAMES = ("SK_ID_CURR", "case_id", "id", "ID", "application_id")


def common_id(a: DataFrame, b: DataFrame) -> str | None:
    """The first known id name that both have."""
    return next((n for n in ID_NAMES if n in a.columns and n in b.columns), None)


def merge_on_id(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner join on the common id; a column on both sides comes from predictions. Raises without a common id: rows have
    no order here, so they are never matched by position."""
    key = common_id(features, predictions)
    if key is None:
        raise ValueError("no common id; add one where the data are read, with number_rows()")
    return features.drop(*[c for c in features.columns if c in predictions.columns and c != key]).join(predictions, key)


def number_rows(df: DataFrame, order: list[str], name: str = "case_id") -> DataFrame:
    """Consecutive numbers from 1 by a total order whose first column is numeric (see ranks.ranked)."""
    return ranked(df, order, name, "__n").drop("__n")


def positional_join(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row k of a beside row k of b, each side by its own total order; a column on both sides comes from a. Raises where
    the sides differ in length."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}: join on an id instead")
    left, right = number_rows(a, order_a, "__at"), number_rows(b, order_b, "__at")
    return left.join(right.drop(*[c for c in right.columns if c in a.columns]), "__at").drop("__at")
