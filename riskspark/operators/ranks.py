"""Exact ranks, running sums and quantiles without sorting a group in one task.

For ranks and sums, rows are cut into slices at sampled quantiles of the order column. Each slice is sorted by itself;
the slices' totals, a few hundred a group, are summed among themselves. A value so frequent that it is a cut has a slice
of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.schema import col, is_numeric

SLICES = 256
#: Of a quantile's sketch, as a share of the rows.
ERROR = 1 / 50_000


def on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that takes null keys as equal; without keys, right is one row (an aggregate without groups)."""
    if not keys:
        return left.join(F.broadcast(right), how="cross") if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    marked = right.select(*[col(k).alias(f"__{k}") for k in keys], *[col(c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in keys])
    return left.join(marked, same, how).drop(*[f"__{k}" for k in keys])


def held(df: DataFrame) -> DataFrame:
    """A table of a few rows (a row a week, bin or feature), computed once and kept in the plan as it is."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def place(x: Column, edges: Column, inclusive: bool = True) -> Column:
    """How many of up to 1023 ascending edges are at or below x (below it, if not inclusive), by binary search."""
    under = (lambda e: e <= x) if inclusive else (lambda e: e < x)
    steps = F.array(*[F.lit(1 << k) for k in range(9, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(under(F.get(edges, at + s - 1)), at + s).otherwise(at))


def sliced(df: DataFrame, order: list[str], slices: int = SLICES) -> DataFrame:
    """df with `__slice`, ascending with the order. The first column is numeric; a value that is a cut is a slice of its
    own, and that is cut further by the second column, if there is one and it is numeric."""
    kinds = dict(df.dtypes)
    use = [o for o in order[:2] if is_numeric(kinds[o])]
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = df.agg(*[F.array_distinct(F.percentile_approx(col(o).cast("double"), shares, 4 * slices)).alias(f"__cuts{i}") for i, o in enumerate(use)])
    x = df.join(F.broadcast(cuts), how="cross")  # one row of two arrays
    v = col(use[0]).cast("double")
    after, upto = place(v, F.col("__cuts0"), False), place(v, F.col("__cuts0"))
    inner = F.when(after != upto, place(col(use[1]).cast("double"), F.col("__cuts1"))).otherwise(0) if len(use) > 1 else F.lit(0)
    return x.withColumn("__slice", F.when(v.isNotNull(), (after + upto) * 1024 + inner).otherwise(-1)).drop(*[f"__cuts{i}" for i in range(len(use))])


def cumulate(df: DataFrame, order: str, sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """df, one row for each (keys, order), with `cum_<x>` (the running sum up to and with the row) and `all_<x>`."""
    keys = keys or []
    cut = sliced(df, [order])
    inside = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "__slice").agg(*[F.sum(x).alias(f"__t_{x}") for x in sums])
    whole = Window.partitionBy(*keys)  # a row a slice
    before = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__slice", *[F.coalesce(F.sum(f"__t_{x}").over(before), F.lit(0)).alias(f"__b_{x}") for x in sums], *[F.sum(f"__t_{x}").over(whole).alias(f"all_{x}") for x in sums])
    made = cut.select("*", *[F.sum(x).over(inside).alias(f"__i_{x}") for x in sums])
    joined = on(made, totals, [*keys, "__slice"])
    return joined.select(*[col(c) for c in df.columns], *[(F.col(f"__i_{x}") + F.col(f"__b_{x}")).alias(f"cum_{x}") for x in sums], *[F.col(f"all_{x}") for x in sums])


def ranked(df: DataFrame, order: list[str], name: str = "rank", total: str = "n", descending: bool = False) -> DataFrame:
    """df with its row number from 1 by a total order, the first column descending if asked, and the number of rows."""
    cut = sliced(df, order)
    outer = F.floor(F.col("__slice") / 1024)
    by = [outer.desc() if descending else outer, F.col("__slice")]
    sizes = cut.groupBy("__slice").agg(F.count("*").alias("__c"))
    line = Window.orderBy(*by)  # a row a slice
    sizes = sizes.select("__slice", F.coalesce(F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"), F.sum("__c").over(Window.partitionBy()).alias(total))
    first = col(order[0]).desc() if descending else col(order[0])
    inside = Window.partitionBy("__slice").orderBy(first, *[col(o) for o in order[1:]])
    made = cut.withColumn("__r", F.row_number().over(inside)).join(F.broadcast(sizes), "__slice")
    return made.withColumn(name, F.col("__r") + F.col("__b")).drop("__slice", "__r", "__b")


def quantiles(df: DataFrame, x: str | Column, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q): the exact, linearly interpolated quantiles of x by group, as an array in the order of probs.

    A first pass finds, by mergeable sketches, two values around each wanted one (their ranks are ERROR of the rows away
    at most). A second counts the rows, by value between such two and in one sum elsewhere, so that a group's task sorts
    some 1 / 5,000 of its distinct values. Groups without values give no row.
    """
    keys, k = keys or [], len(probs)
    v = (col(x) if isinstance(x, str) else x).cast("double")
    rows = df.select(*[col(c) for c in keys], v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    around = [[min(1.0, max(0.0, p + side * m)) for side in (-1, 1) for p in probs] for m in (4 * ERROR, 0.01, 1.0)]
    sketch = F.percentile_approx("__v", F.array(*[F.lit(p) for m in around for p in m]), int(1 / ERROR))
    near = rows.groupBy(*keys).agg(sketch.alias("__a"), F.count("*").alias("__m")).where("__m > 0")
    # a bracket takes in four ranks on each side at least; few rows are all in it
    near = near.withColumn("__a", F.slice("__a", F.when(F.col("__m") * (4 * ERROR) >= 4, 1).when(F.col("__m") >= 400, 2 * k + 1).otherwise(4 * k + 1), 2 * k))
    near = near.select(*[col(c) for c in keys], "__a", F.array_sort(F.array_distinct("__a")).alias("__e"))
    kept = reduce(lambda a, b: a | b, [F.col("__v").between(F.col("__a")[i], F.col("__a")[k + i]) for i in range(k)])
    z = on(rows, F.broadcast(near), keys)  # a row a group
    counts = z.groupBy(*keys, place(F.col("__v"), F.col("__e")).alias("__z"), F.when(kept, F.col("__v")).alias("__s")).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*keys).orderBy("__z", F.col("__s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select("*", F.sum("__c").over(line).alias("__u"), F.sum("__c").over(Window.partitionBy(*keys)).alias("__n"))
    found = F.coalesce("__s", F.raise_error(F.lit("a quantile lies outside its sketch's bounds")).cast("double"))
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    holds = lambda r: (r >= F.col("__u") - F.col("__c")) & (r < F.col("__u"))
    ends = [e for i, r in enumerate(at) for e in (F.max(F.when(holds(F.floor(r)), found)).alias(f"__lo{i}"), F.max(F.when(holds(F.ceil(r)), found)).alias(f"__hi{i}"))]
    g = cum.groupBy(*keys).agg(F.max("__n").alias("__n"), *ends)
    value = lambda i: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at[i] - F.floor(at[i]))
    out = g.select(*[col(c) for c in keys], F.array(*[value(i) for i in range(k)]).alias("q"), "__n")
    return out.where("__n is not null").drop("__n")
