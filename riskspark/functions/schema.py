"""Columns typed by the last letter of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names with a type of their own; suffix rules never touch them.
RESERVED = {"case_id": "bigint", "WEEK_NUM": "bigint", "num_group1": "bigint", "num_group2": "bigint", "date_decision": "date"}
UNTYPED = {"target"}
#: The type that a last letter stands for.
BY_SUFFIX = {"P": "double", "A": "double", "M": "string", "D": "date"}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def suffix(name: str) -> str:
    """The last letter of a name; empty for reserved names."""
    return "" if name in RESERVED or name in UNTYPED else name[-1:]


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def col(name: str):
    return F.col(f"`{name}`")


def cast_by_suffix(df: DataFrame, strict: bool = True) -> DataFrame:
    """Every column as its name says, in one projection; strict casts raise on bad values, others give null."""
    out = []
    for name in df.columns:
        kind = RESERVED.get(name) or BY_SUFFIX.get(suffix(name))
        c = col(name)
        out.append((c.cast(kind) if strict else c.try_cast(kind)).alias(name) if kind else c)
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is null everywhere in this library."""
    return df.select(*[F.when(~F.isnan(col(n)), col(n)).alias(n) if t in ("float", "double") else col(n) for n, t in df.dtypes])


def narrow(df: DataFrame) -> DataFrame:
    """Integer columns in the smallest type whose range holds them strictly; one pass for the bounds. Floats stay."""
    whole = [n for n, t in df.dtypes if t in ("smallint", "int", "bigint")]
    if not whole:
        return df
    row = df.agg(*[f(col(n)).alias(f"{f.__name__}{i}") for i, n in enumerate(whole) for f in (F.min, F.max)]).first()
    kinds = {}
    for i, n in enumerate(whole):
        lo, hi = row[f"min{i}"], row[f"max{i}"]
        for kind, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
            if lo is not None and -(1 << bits - 1) < lo and hi < (1 << bits - 1) - 1:
                kinds[n] = kind
                break
    return df.select(*[col(n).cast(kinds[n]).alias(n) if n in kinds else col(n) for n in df.columns])


def widen(df: DataFrame, key: str = "case_id", target: str = "target") -> DataFrame:
    """Small integers as int, the target as bigint, float as double; the key as bigint."""
    kinds = {key: "bigint", target: "bigint"}
    by_type = {"tinyint": "int", "smallint": "int", "float": "double"}
    return df.select(*[col(n).cast(kinds.get(n) or by_type.get(t, t)).alias(n) for n, t in df.dtypes])


def normalise(df: DataFrame, week: str = "WEEK_NUM") -> DataFrame:
    """Types as a model reads them: booleans as tinyint, doubles as float, the week as smallint (0 where it is no number).
    Integers, floats and strings stay; any other type is an error."""
    out = []
    for n, t in df.dtypes:
        if n == week:
            out.append(F.coalesce(col(n).cast("string").try_cast("double").cast("smallint"), F.lit(0).cast("smallint")).alias(n))
        elif t == "boolean":
            out.append(col(n).cast("tinyint").alias(n))
        elif t == "double" or t.startswith("decimal"):
            out.append(col(n).cast("float").alias(n))
        elif t in ("tinyint", "smallint", "int", "bigint", "float", "string"):
            out.append(col(n))
        else:
            raise ValueError(f"no rule for column {n} of type {t}")
    return df.select(*out)


def nominal(df: DataFrame, domains: dict[str, int] | None = None) -> DataFrame:
    """Columns with a fixed integer domain, marked as nominal for pyspark.ml; values outside it are null."""
    domains = domains or {"month_decision": 12, "weekday_decision": 7}
    out = []
    for n in df.columns:
        if n in domains:
            meta = {"ml_attr": {"type": "nominal", "name": n, "vals": [str(i) for i in range(1, domains[n] + 1)]}}
            out.append(F.when(col(n).between(1, domains[n]), col(n).cast("int")).alias(n, metadata=meta))
        else:
            out.append(col(n))
    return df.select(*out)
