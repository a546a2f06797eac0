"""The risk-data model on the test tables: an order is a case, its lines are child rows; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.numeric import rounded
from riskspark.operators.prepare import Weeks

WEEKS = Weeks(257, 279)
CAPS = (0.10, 0.15, 0.20)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: What makes child rows of a case come in one order; rows that tie are equal in every column.
LINE_ORDER = ["num_group1", "l_partkey", "l_suppkey", "shipdate_7D", "extprice_2A", "quantity_1P", "discount_3P", "tax_4P", "returnflag_5M", "linestatus_6L"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an order: week and weekday, target, and a score that leans on it."""
    day = F.col("o_orderdate").cast("date")
    y = ((F.col("o_orderkey") * 7919) % 10007) / F.lit(10007.0)
    target = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), day.alias("date_decision"), F.floor(F.date_diff(day, F.lit("1995-01-01").cast("date")) / 7).cast("bigint").alias("WEEK_NUM"),
        (F.weekday(day) + 1).alias("weekday_decision"), target.alias("target"), (F.lit(0.7) * y + F.lit(0.3) * target).alias("y_prob"),
        F.col("o_orderpriority").alias("priority_1M"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price_1A"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line, under suffix-typed names."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as case_id", "l_linenumber as num_group1", "l_partkey", "l_suppkey", "l_quantity as quantity_1P", "l_extendedprice as extprice_2A", "l_discount as discount_3P",
        "l_tax as tax_4P", "l_returnflag as returnflag_5M", "l_linestatus as linestatus_6L", "l_shipdate as shipdate_7D",
    )


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from riskspark.operators.prepare import time_split

    s = time_split(cases(spark, sf_dir), WEEKS)
    return s["train"], s["val"], s["test"]


#: SQL for cases() and its splits.
CASES = """cases as (select o_orderkey as case_id, cast(o_orderdate as date) as date_decision,
 cast(floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 7e0) as bigint) as week_num,
 cast(isodow(cast(o_orderdate as date)) as integer) as weekday_decision, cast(o_orderstatus = 'F' as integer) as target,
 0.7e0 * (((o_orderkey * 7919) % 10007) / 10007e0) + 0.3e0 * cast(o_orderstatus = 'F' as integer) as y_prob,
 o_orderpriority as priority_1m, o_custkey as custkey, o_totalprice as price_1a from orders),
train as (select * from cases where week_num <= 257), val as (select * from cases where week_num between 258 and 279),
test as (select * from cases where week_num >= 280)"""


def R(x: str) -> str:
    """SQL for rounded()."""
    return f"floor(cast({x} as double) * 1e6 + 0.5e0) / 1e6"


def tidy(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles rounded by the common rule, whole numbers as bigint; columns named in `exact` as they are."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if n not in exact and t in ("double", "float"):
            c = rounded(c).alias(n)
        elif t in ("tinyint", "smallint", "int"):
            c = c.cast("bigint").alias(n)
        out.append(c)
    return df.select(*out)
