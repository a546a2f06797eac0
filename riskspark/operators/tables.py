"""From child tables to one row a case: filling, group aggregates, coalescing joins, day differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.schema import RESERVED, cast_by_suffix, col, is_numeric, suffix
from riskspark.functions.rules import add_combos


def fill_by_suffix(df: DataFrame) -> DataFrame:
    """Nulls of numeric P and A columns become 0; of M columns "missing", or -1 in numeric zip columns.

    Names without an underscore, other suffixes and reserved names stay.
    """
    out = []
    for name, kind in df.dtypes:
        c, s = col(name), suffix(name) if "_" in name else ""
        if s in ("A", "P") and is_numeric(kind):
            c = F.coalesce(c, F.lit(0).cast(kind)).alias(name)
        elif s == "M" and "zip" in name.lower() and is_numeric(kind):
            c = F.coalesce(c, F.lit(-1).cast(kind)).alias(name)
        elif s == "M" and kind == "string":
            c = F.coalesce(c, F.lit("missing")).alias(name)
        out.append(c)
    return df.select(*out)


def soft_impute(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Fills the assembled table: 0 for numbers that end in A, P, D, o or g; "missing" (numeric zip: -1) for M;
    0 or "UNKNOWN" for T and L. Names that end in `delta` and reserved names stay."""
    out = []
    for name, kind in df.dtypes:
        c, s = col(name), "" if name in skip else suffix(name)
        number = is_numeric(kind)
        if s in ("A", "P", "D", "o", "g") and number:
            c = F.coalesce(c, F.lit(0).cast(kind)).alias(name)
        elif s == "M":
            c = (F.coalesce(c, F.lit(-1).cast(kind)) if number and "zip" in name.lower() else F.coalesce(c.cast("string"), F.lit("missing"))).alias(name)
        elif s in ("T", "L"):
            c = (F.coalesce(c, F.lit(0).cast(kind)) if number else F.coalesce(c.cast("string"), F.lit("UNKNOWN"))).alias(name)
        out.append(c)
    return df.select(*out)


def suffix_aggregates(df: DataFrame, key: str = "case_id") -> tuple[list[Column], list[str]]:
    """The max_ and mean_ columns that each name's suffix or ending asks for, and the names that want a last_ column; a
    date's mean is a day number."""
    out: list[Column] = []
    lasts: list[str] = []
    for name, _ in df.dtypes:
        if name == key:
            continue
        s, c = suffix(name), col(name)
        if name.startswith("num_group") or s in ("M", "T", "L"):
            kinds = ("max",)
        elif s in ("P", "A", "D") or name.endswith(("flag", "ratio", "delta")):
            kinds = ("max", "mean")
        else:
            continue
        mean = F.avg(F.unix_date(c)) if s == "D" else F.avg(c)
        out += [(F.max(c) if k == "max" else mean).alias(f"{k}_{name}") for k in kinds]
        lasts.append(name)
    return out, lasts


def aggregate_child(df: DataFrame, order: list[str], key: str = "case_id") -> DataFrame:
    """One row a key: one pre-aggregated pass, whatever the number of columns. The last row's values travel as one
    struct, so the order is compared once a row and not once a column."""
    made, lasts = suffix_aggregates(df, key)
    if lasts:
        made.append(F.max_by(F.struct(*[col(c) for c in lasts]), F.struct(*[col(o) for o in order])).alias("__last"))
    g = df.where(col(key).isNotNull()).groupBy(key).agg(*made)
    return g.select(*[col(c) for c in g.columns if c != "__last"], *[F.col("__last")[c].alias(f"last_{c}") for c in lasts])


def prepare_child(df: DataFrame, order: list[str] | None = None, depth: int | None = None, key: str = "case_id") -> DataFrame:
    """Casts, fills and rules; depths 1 and 2 are then aggregated to one row a case."""
    made = add_combos(fill_by_suffix(cast_by_suffix(df)))
    return aggregate_child(made, order or [c for c in ("num_group1", "num_group2") if c in df.columns], key) if depth in (1, 2) else made


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`, by a pre-aggregated minimum rather than a window."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(o) for o in order])).alias("__r"))
    return best.select(key, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def coalescing_join(base: DataFrame, others: list[DataFrame], key: str = "case_id") -> DataFrame:
    """Left joins in the given order; where a name is on both sides, the left value wins unless it is null.

    Each right side has one row a key. All joins share the key, so a partitioning by it is made once and used again.
    """

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        both = [c for c in right.columns if c != key and c in left.columns]
        new = right.select(key, *[col(c).alias(f"{c}__new" if c in both else c) for c in right.columns if c != key])
        joined = left.join(new, key, "left")
        same = [F.coalesce(col(c), col(f"{c}__new")).alias(c) if c in both else col(c) for c in left.columns]
        return joined.select(*same, *[col(c) for c in right.columns if c != key and c not in both])

    return reduce(step, others, base)


def calendar_parts(df: DataFrame) -> DataFrame:
    """month_decision, and weekday_decision from 1 for Monday."""
    return df.select("*", F.month("date_decision").alias("month_decision"), (F.weekday("date_decision") + 1).alias("weekday_decision"))


def date_deltas(df: DataFrame) -> DataFrame:
    """Every D column as whole days from the decision, truncated; then date_decision and MONTH go."""
    out = []
    for name, kind in df.dtypes:
        if name in ("date_decision", "MONTH"):
            continue
        if suffix(name) == "D" and (kind == "date" or is_numeric(kind)):
            days = F.unix_date(col(name)) if kind == "date" else col(name)
            out.append((days - F.unix_date("date_decision")).cast("bigint").alias(name))
        else:
            out.append(col(name))
    return df.select(*out)


def informative_strings(df: DataFrame, most: int = 200) -> DataFrame:
    """Drops string columns with one value or more than `most` (null counts as a value), found in one pass."""
    text = [n for n, t in df.dtypes if t == "string" and n not in (*RESERVED, "target")]
    if not text:
        return df
    row = df.agg(*[(F.count_distinct(col(n)) + F.max(col(n).isNull().cast("int"))).alias(f"c{i}") for i, n in enumerate(text)]).first()
    return df.drop(*[n for i, n in enumerate(text) if row[f"c{i}"] == 1 or row[f"c{i}"] > most])


def assemble(base: DataFrame, depth0: list[DataFrame], depth1: list[DataFrame], depth2: list[DataFrame]) -> DataFrame:
    """The whole first stage: calendar parts, joins in the order of depths, day differences."""
    return date_deltas(coalescing_join(calendar_parts(base), [*depth0, *depth1, *depth2]))
