"""Queries on assembling, cleaning and encoding."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import rules
from riskspark.functions.schema import cast_by_suffix, narrow, nominal, widen
from riskspark.operators import prepare, tables

from .cases import CASES, LINE_ORDER, R, WEEKS, cases, lines, query, table, tidy

_ROW = "row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"
_last = lambda c: f"arg_max_null({c}, {_ROW})"
_days = lambda c: f"date_diff('day', date '1970-01-01', cast({c} as date))"
_PAIRS = [("l_quantity", "quantity_1P"), ("l_extendedprice", "extprice_2A"), ("l_discount", "discount_3P"), ("l_tax", "tax_4P")]
_AGG = ", ".join(f"{R(f'max({c})')} as max_{n}, {R(_last(c))} as last_{n}, {R(f'avg({c})')} as mean_{n}" for c, n in _PAIRS)


@query(
    f"""select l_orderkey as case_id, cast(max(l_linenumber) as bigint) as max_num_group1, cast({_last('l_linenumber')} as bigint) as last_num_group1, {_AGG},
 max(l_returnflag) as max_returnflag_5M, {_last('l_returnflag')} as last_returnflag_5M, max(l_linestatus) as max_linestatus_6L, {_last('l_linestatus')} as last_linestatus_6L,
 max(cast(l_shipdate as date)) as max_shipdate_7D, {_last('cast(l_shipdate as date)')} as last_shipdate_7D, {R(f"avg({_days('l_shipdate')})")} as mean_shipdate_7D
 from lineitem group by 1"""
)
def suffix_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tables.aggregate_child(cast_by_suffix(lines(spark, d)), LINE_ORDER))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    base = cases(spark, d).select("case_id", "date_decision", F.when(F.col("case_id") % 3 != 0, F.col("price_1A")).alias("amount_1A"))
    one = lines(spark, d).groupBy("case_id").agg(F.max("extprice_2A").alias("amount_1A"), F.max("shipdate_7D").cast("date").alias("shipped_2D"))
    two = lines(spark, d).groupBy("case_id").agg(F.count("*").alias("lines_3A"), F.min("extprice_2A").alias("amount_1A"))
    return tables.coalescing_join(base, [one, two])


_JOINED = """j as (select c.case_id, c.date_decision, coalesce(case when c.case_id % 3 <> 0 then price_1a end, a.hi, a.lo) as amount_1A, a.shipped as shipped_2D, a.n as lines_3A
 from cases c left join (select l_orderkey, max(l_extendedprice) hi, min(l_extendedprice) lo, max(cast(l_shipdate as date)) shipped, count(*) n from lineitem group by 1) a on l_orderkey = c.case_id)"""


@query(f"with {CASES}, {_JOINED} select case_id, date_decision, {R('amount_1A')} as amount_1A, shipped_2D, lines_3A from j")
def coalescing_join(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_joined(spark, d))


@query(
    f"""with {CASES}, {_JOINED} select case_id, {R('amount_1A')} as amount_1A, date_diff('day', date_decision, shipped_2D) as shipped_2D, lines_3A,
 cast(month(date_decision) as bigint) as month_decision, cast(isodow(date_decision) as bigint) as weekday_decision from j"""
)
def date_deltas(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tables.date_deltas(tables.calendar_parts(_joined(spark, d))))


@query(
    f"""with {CASES}, a as (select l_orderkey, {_last('l_quantity')} as q, avg({_days('l_shipdate')}) as m, count(*) as n from lineitem group by 1)
 select case_id, week_num as "WEEK_NUM", cast(target as bigint) as target, cast(month(date_decision) as bigint) as month_decision, cast(weekday_decision as bigint) as weekday_decision,
 {R('q')} as last_quantity_1P, cast(trunc(m - {_days('date_decision')}) as bigint) as mean_shipdate_7D from cases left join a on l_orderkey = case_id"""
)
def assembled_cases(spark: SparkSession, d: str) -> DataFrame:
    child = tables.prepare_child(lines(spark, d), LINE_ORDER, depth=1).select("case_id", "last_quantity_1P", "mean_shipdate_7D")
    base = cases(spark, d).select("case_id", "date_decision", "WEEK_NUM", "target")
    return tidy(tables.assemble(base, [], [child], [])).select("case_id", "WEEK_NUM", "target", "month_decision", "weekday_decision", "last_quantity_1P", "mean_shipdate_7D")


#: Stand-ins for the rules' inputs on the test tables.
_STAND = ("l_quantity", "l_extendedprice / 1e3", "l_discount * 1e3", "l_tax * 1e3", "l_quantity - 25e0", "l_linenumber * 20e0")
_NEEDS = list(dict.fromkeys(c for r in rules.CHILD_RULES.values() for c in rules.required(r)))
_CASE_NEEDS = list(dict.fromkeys(c for r in rules.CASE_RULES.values() for c in rules.required(r)))
_inputs = lambda names: [f"{_STAND[(i * 7 + i // 6) % 6]} as {c}" for i, c in enumerate(names)]


def _sql_rule(rule: str) -> str:
    m = re.fullmatch(r"(?:tiny)?int\((.*)\)", rule)
    return f"cast(({m[1]}) as bigint)" if m else R(rule)


def _rules_sql(all_rules: dict[str, str], names: list[str]) -> str:
    made = ", ".join(f"{_sql_rule(r)} as {n}" for n, r in all_rules.items())
    return f"with x as (select l_orderkey, l_linenumber, l_partkey, {', '.join(_inputs(names))} from lineitem) select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, {made} from x"


@query(_rules_sql(rules.CHILD_RULES, _NEEDS))
def combo_rules(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *_inputs(_NEEDS))
    return tidy(rules.add_combos(x).select("l_orderkey", "l_linenumber", "l_partkey", *rules.CHILD_RULES))


@query(_rules_sql(rules.CASE_RULES, _CASE_NEEDS))
def post_combos(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *_inputs(_CASE_NEEDS))
    return tidy(rules.add_case_combos(x).select("l_orderkey", "l_linenumber", "l_partkey", *rules.CASE_RULES))


_HOLES = """select l_orderkey as case_id, l_partkey, case when l_linenumber % 2 = 0 then l_quantity end as quantity_1P, case when l_linenumber % 3 = 0 then l_tax end as tax_2A,
 case when l_linenumber % 2 = 1 then l_returnflag end as flag_3M, case when l_linenumber % 4 = 0 then l_partkey end as zipcode_4M, case when l_linenumber % 3 = 1 then l_linestatus end as status_5L,
 case when l_linenumber % 5 = 0 then l_discount end as discount_ratio, case when l_linenumber % 5 = 1 then l_discount end as discount_delta from lineitem"""


def _holes(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    return spark.sql(_HOLES.replace("from lineitem", "from __lineitem"))


@query(
    f"""with x as ({_HOLES}) select case_id, l_partkey, {R('coalesce(quantity_1P, 0)')} as quantity_1P, {R('coalesce(tax_2A, 0)')} as tax_2A, coalesce(flag_3M, 'missing') as flag_3M,
 coalesce(zipcode_4M, -1) as zipcode_4M, status_5L, {R('discount_ratio')} as discount_ratio, {R('discount_delta')} as discount_delta from x"""
)
def fill_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tables.fill_by_suffix(_holes(spark, d)))


@query(
    f"""with x as ({_HOLES}) select case_id, l_partkey, {R('coalesce(quantity_1P, 0)')} as quantity_1P, {R('coalesce(tax_2A, 0)')} as tax_2A, coalesce(flag_3M, 'missing') as flag_3M,
 coalesce(zipcode_4M, -1) as zipcode_4M, coalesce(status_5L, 'UNKNOWN') as status_5L, {R('coalesce(discount_ratio, 0)')} as discount_ratio, {R('discount_delta')} as discount_delta from x"""
)
def soft_impute(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tables.soft_impute(_holes(spark, d)))


@query("select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment from orders join customer on c_custkey = o_custkey")
def filter_cols_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name", F.lit("one").alias("constant"))
    return tables.informative_strings(x, most=100)


_WIN = "l_orderkey as case_id, l_linenumber as line, l_quantity as quantity_1P, l_extendedprice as price_2A, l_tax * 1e2 - 2e0 as tax_ratio, cast(l_discount > 0.05e0 as integer) as flag_3P"


@query(
    f"""with x as (select {_WIN} from lineitem), q as (select quantile_cont(quantity_1P, 0.998) a, quantile_cont(price_2A, 0.998) b, greatest(1, quantile_cont(tax_ratio, 0.998)) c from x)
 select case_id, cast(line as bigint) as line, {R('least(quantity_1P, a)')} as quantity_1P, {R('least(price_2A, b)')} as price_2A, {R('greatest(0, least(tax_ratio, c))')} as tax_ratio, cast(flag_3P as bigint) as flag_3P from x, q"""
)
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    x = spark.sql(f"select {_WIN}, 1 as constant_4A, cast(null as double) as gone_5P from __lineitem")
    return tidy(prepare.Pruner.fit(x, skip=("case_id", "line")).transform(x))


@query(
    f"""with x as (select {_WIN} from lineitem) select 'quantity_1P' as feature, {R('quantile_cont(quantity_1P, 0.998)')} as high from x union all select 'price_2A', {R('quantile_cont(price_2A, 0.998)')} from x
 union all select 'tax_ratio', {R('greatest(1, quantile_cont(tax_ratio, 0.998))')} from x"""
)
def winsor_bounds(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    p = prepare.Pruner.fit(spark.sql(f"select {_WIN} from __lineitem"), skip=("case_id", "line"))
    return tidy(spark.createDataFrame(sorted(p.high.items()), "feature string, high double"))


@query(f"with {CASES} select case when week_num <= 257 then 'train' when week_num <= 279 then 'val' else 'test' end as split, count(*) as n, cast(sum(target) as bigint) as bad from cases group by 1")
def time_split_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [x.agg(F.lit(n).alias("split"), F.count("*").alias("n"), F.sum("target").alias("bad")) for n, x in prepare.time_split(cases(spark, d), WEEKS).items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    f"with {CASES}, f as (select unnest([242, 246, 250, 254]) as v) select cast(v as bigint) as val_start, count(*) filter (week_num < v) as train_n, count(*) filter (week_num between v and v + 3) as val_n from cases, f where week_num <= 257 group by 1"
)
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    x, out = cases(spark, d), None
    for fold in prepare.expanding_folds(0, WEEKS.train_end):
        a, b = prepare.fold_frames(x, fold)
        row = a.agg(F.lit(fold[1]).cast("bigint").alias("val_start"), F.count("*").alias("train_n")).join(b.agg(F.count("*").alias("val_n")), how="cross")
        out = row if out is None else out.unionAll(row)
    return out


@query("select o_orderkey as case_id, " + ", ".join(f"cast(o_orderpriority = '{p}' as bigint) as \"priority_1M_{p}\"" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from orders")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", "target", "priority_1M")
    made = prepare.Encoder.fit(x).one_hot(x)
    return tidy(made.drop("target"))


def _te_sql(history: str, own: str) -> str:
    return f"""with {CASES}, g as (select avg(target) as gm from train), rows_ as (select *, 1 as seg from {own} {f'union all select *, 0 from {history}' if history else ''}),
 r as (select case_id, seg, priority_1m, target, week_num, weekday_decision, coalesce(sum(target) over w, 0) as s, count(target) over w as c, avg(target) over (partition by priority_1m order by seg, week_num, weekday_decision, case_id rows between 100 preceding and 1 preceding) as recent
 from rows_ window w as (partition by priority_1m order by seg, week_num, weekday_decision, case_id rows between unbounded preceding and 1 preceding)),
 m as (select *, case when c >= 50 then (s + gm * 100e0 / (c + 10)) / (c + 100e0 / (c + 10)) else gm end as te from r, g where seg = 1)
 select case_id, {R('te')} as priority_te, {R('case when c >= 50 then recent - te else 0 end')} as priority_trend from m"""


def _te(spark: SparkSession, d: str, split: str, history: str | None) -> DataFrame:
    s = prepare.time_split(cases(spark, d), WEEKS)
    mean = s["train"].agg(F.avg("target")).first()[0]
    made = prepare.running_target_encode(s[split], s[history] if history else None, "priority_1M", ["WEEK_NUM", "weekday_decision", "case_id"], prior=mean)
    return tidy(made.select("case_id", F.col("priority_1M_te").alias("priority_te"), F.col("priority_1M_trend").alias("priority_trend")))


@query(_te_sql("train", "train"))
def target_encode_reference(spark: SparkSession, d: str) -> DataFrame:
    return _te(spark, d, "train", "train")


@query(_te_sql("", "train"))
def target_encode_causal(spark: SparkSession, d: str) -> DataFrame:
    return _te(spark, d, "train", None)


@query(_te_sql("train", "val"))
def target_encode_carried(spark: SparkSession, d: str) -> DataFrame:
    """As target_encode_validation, from the state kept of the training rows in place of the rows."""
    s, order = prepare.time_split(cases(spark, d), WEEKS), ["WEEK_NUM", "weekday_decision", "case_id"]
    mean = s["train"].agg(F.avg("target")).first()[0]
    made = prepare.running_target_encode(s["val"], None, "priority_1M", order, prior=mean, state=prepare.encoder_state(s["train"], "priority_1M", order))
    return tidy(made.select("case_id", F.col("priority_1M_te").alias("priority_te"), F.col("priority_1M_trend").alias("priority_trend")))


@query(_te_sql("train", "val"))
def target_encode_validation(spark: SparkSession, d: str) -> DataFrame:
    return _te(spark, d, "val", "train")


@query(
    """select l_orderkey, cast(l_linenumber as bigint) as num_group1, l_quantity as quantity_1P, cast(cast(l_partkey as double) as double) as part_2A, cast(l_suppkey as varchar) as supp_3M, cast(l_shipdate as date) as ship_4D, l_linestatus as status_5L from lineitem"""
)
def suffix_cast(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber as num_group1", "l_quantity as quantity_1P", "l_partkey as part_2A", "l_suppkey as supp_3M", "l_shipdate as ship_4D", "l_linestatus as status_5L")
    return cast_by_suffix(x)


@query("select l_orderkey, cast(l_linenumber as integer) as l_linenumber, cast(month(l_shipdate) as integer) as month_decision from lineitem")
def narrow_and_widen(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.month("l_shipdate").alias("month_decision"))
    return nominal(widen(narrow(x), key="l_orderkey"), {"month_decision": 12})


@query("select c_nationkey as case_id, max(c_acctbal) as balance_1A from customer group by 1")
def one_per_key(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_acctbal").alias("balance_1A"), (-F.col("c_acctbal")).alias("o"))
    return tables.one_per_key(x, "case_id", ["o"]).drop("o")
