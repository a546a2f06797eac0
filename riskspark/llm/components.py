"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored


def _large_star(edges: DataFrame) -> DataFrame:
    """edges has u > v. Every larger neighbour of a node is linked to the least node around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _sign(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node long, component long) of every node that edges (a long, b long) name; component is its least node.

    No group is ever gathered: each step is a pre-aggregated minimum and an equi-join, and each round is written to the
    shared folder, so a lost executor costs one round at most. Loops and repeated or null edges are ignored. The rounds
    end when the edge set no longer changes; it is then a set of stars.
    """
    clean = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at, before = Stored(clean, "edges"), None
    now = _sign(at.df)
    for _ in range(rounds):
        if not now[0] or now == before:
            break
        new = Stored(_small_star(_large_star(at.df).distinct()).distinct(), "edges")
        at.drop()
        at, before, now = new, now, _sign(new.df)
    else:
        raise RuntimeError(f"components had not settled after {rounds} rounds")
    stars = at.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
