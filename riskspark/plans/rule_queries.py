"""Queries on readers and writers, types, row positions, contributions by bins, and trees small enough for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.numeric import finite
from riskspark.functions.schema import cast_by_suffix, normalise
from riskspark.operators import drift, join, metrics, model, prepare, tables
from riskspark.sources import files
from riskspark.sources.scratch import scratch

from .cases import CASES, LINE_ORDER, R, WEEKS, cases, lines, query, splits, table, tidy

_ROW = "row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"
_LINES = f"select l_orderkey as case_id, {R('max(l_quantity)')} as max_quantity_1P, {R(f'arg_max_null(l_tax, {_ROW})')} as last_tax_4P, {R('avg(l_discount)')} as mean_discount_3P, max(l_returnflag) as max_returnflag_5M from lineitem group by 1"
_LINE_COLS = ["case_id", "max_quantity_1P", "last_tax_4P", "mean_discount_3P", "max_returnflag_5M"]


@query(_LINES)
def read_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    files.write_parquet(lines(spark, d), path)
    return tidy(files.read_table(spark, path, 1, LINE_ORDER).select(*_LINE_COLS))


@query(_LINES)
def read_files(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "parts")
    for i in range(3):
        files.write_parquet(lines(spark, d).where(F.col("l_partkey") % 3 == i), f"{at}/part_{i}", dictionary=False)
    return tidy(files.read_tables(spark, f"{at}/part_*", 1, LINE_ORDER).select(*_LINE_COLS))


@query(f"select c_custkey as case_id, {R('c_acctbal')} as balance_1A, c_mktsegment as segment_2M from customer")
def read_files_unique(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "customers")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("balance_1A"), F.col("c_mktsegment").alias("segment_2M"))
    files.write_parquet(c.where("case_id % 4 < 3"), f"{at}/unique_1")
    files.write_parquet(c.where("case_id % 4 > 0"), f"{at}/unique_2")
    return tidy(files.read_tables(spark, f"{at}/unique_*"))


@query(f"with {CASES} select case_id, cast(week_num as bigint) as \"WEEK_NUM\", cast(target as bigint) as target, {R('y_prob')} as y_prob from test where case_id % 11 <> 0")
def csv_predictions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "predictions")
    x = splits(spark, d)[2].select("case_id", "WEEK_NUM", "target", F.when(F.col("case_id") % 11 != 0, F.col("y_prob")).alias("y_prob"))
    files.write_csv(x, path)
    return tidy(files.read_csv(spark, path, files.PREDICTIONS).where("y_prob is not null").selectExpr("case_id", "WEEK_NUM", "cast(target as int) as target", "cast(y_prob as double) as y_prob"))


@query(f"with {CASES} select cast(week_num as bigint) as \"WEEK_NUM\", cast(target as bigint) as target, {R('y_prob')} as y_prob from test where case_id % 11 <> 0")
def strict_predictions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "predictions")
    files.write_csv(splits(spark, d)[2].select("case_id", "WEEK_NUM", "target", F.when(F.col("case_id") % 11 != 0, F.col("y_prob")).alias("y_prob")), path)
    return tidy(files.read_predictions(spark, path))


@query(f"with {CASES} select case_id, cast(target as bigint) as target, {R('least(greatest(2 * y_prob - 0.5e0, 0), 1)')} as y_prob from cases where case_id % 5 <> 0 and case_id % 7 <> 0")
def lenient_predictions(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", F.when(F.col("case_id") % 7 == 0, "n/a").otherwise(F.col("target").cast("string")).alias("target"), F.when(F.col("case_id") % 5 == 0, "bad").otherwise((2 * F.col("y_prob") - 0.5).cast("string")).alias("y_prob"))
    return tidy(metrics.valid_predictions(x, ["case_id"], clip_scores=True))


@query("select c_name as value from (select c_name from customer order by c_acctbal desc, c_name limit 10)")
def cached_list(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "names")
    make = lambda: [r.c_name for r in table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_name").limit(10).collect()]
    files.cached_lines(spark, path, make)
    return spark.createDataFrame([(x,) for x in files.cached_lines(spark, path, lambda: [])], "value string")


@query(
    f"""with {CASES} select case_id, cast(case when case_id % 9 = 0 then 0 else week_num end as bigint) as "WEEK_NUM", cast(target = 1 as bigint) as flag, {R('cast(price_1a as float)')} as price, priority_1m as priority from cases"""
)
def normalised_types(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", F.when(F.col("case_id") % 9 == 0, "none").otherwise(F.col("WEEK_NUM").cast("string")).alias("WEEK_NUM"), (F.col("target") == 1).alias("flag"), F.col("price_1A").alias("price"), F.col("priority_1M").alias("priority"))
    made = normalise(x)
    if [t for _, t in made.dtypes] != ["bigint", "smallint", "tinyint", "float", "string"]:
        raise AssertionError(made.dtypes)
    return tidy(made)


@query(f"select l_orderkey, l_partkey, {R('case when l_linenumber % 5 < 3 then 0 when l_linenumber % 5 = 3 then l_tax else -l_tax end')} as x from lineitem")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    bad = F.when(k == 0, float("inf")).when(k == 1, float("nan")).when(k == 3, F.col("l_tax")).when(k == 4, -F.col("l_tax"))
    return tidy(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", finite(bad).alias("x")))


@query("select l_orderkey as case_id, 2 as order_of_tax, 1 as order_of_quantity, count(*) as n from lineitem group by 1")
def aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    x = model.align(lines(spark, d), ["quantity_1P", "tax_4P"], ["case_id"])
    at = {c: i for i, c in enumerate(x.columns)}
    return x.groupBy("case_id").agg(F.lit(at["tax_4P"]).alias("order_of_tax"), F.lit(at["quantity_1P"]).alias("order_of_quantity"), F.count("*").alias("n"))


@query(f"with {CASES} select {R('greatest(1, sum(1 - target) / greatest(1, sum(target))::double)')} as weight from train")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return tidy(spark.createDataFrame([(model.balance(splits(spark, d)[0]),)], "weight double"))


@query("select cast(max(d) as bigint) as dropped, cast(sum(k) as bigint) as kept from (select 3 as d, 0 as k union all select 0, 3)")
def hard_filter(spark: SparkSession, d: str) -> DataFrame:
    """A nearly null, a constant and a many-valued text column go; three stay."""
    x = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("quantity_1P"), F.col("l_returnflag").alias("flag_2M"), F.col("l_linenumber").alias("line"), F.lit(1).alias("one"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(1.5) + F.col("l_tax")).alias("rare_3P"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("name_4M"),
    )
    p = prepare.Pruner.fit(x, most_levels=500)
    if set(p.drop) != {"one", "rare_3P", "name_4M"}:
        raise AssertionError(p.drop)
    return spark.createDataFrame([(len(p.drop), len(p.transform(x).columns))], "dropped long, kept long")


_TRIO = [("l_discount * 2", "cut_flag"), ("l_tax / (1 + l_discount)", "tax_ratio"), ("l_quantity - l_linenumber", "q_delta")]


@query("select l_orderkey as case_id, " + ", ".join(f"{R(f'max({x})')} as max_{n}, {R(f'avg({x})')} as mean_{n}, {R(f'arg_max_null({x}, {_ROW})')} as last_{n}" for x, n in _TRIO) + " from lineitem group by 1")
def flag_ratio_aggregate(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).withColumn("cut_flag", F.col("discount_3P") * 2).withColumn("tax_ratio", F.col("tax_4P") / (1 + F.col("discount_3P"))).withColumn("q_delta", F.col("quantity_1P") - F.col("num_group1"))
    made = tables.aggregate_child(cast_by_suffix(x), LINE_ORDER)
    return tidy(made.select("case_id", *[f"{k}_{n}" for _, n in _TRIO for k in ("max", "mean", "last")]))


_SMALL = "len(list_filter([10, 30, 100, 300], lambda t: t <= o_orderkey % 1000))"


@query(f"""with c as (select {_SMALL} as bin, count(*) as n from orders group by 1), t as (select sum(n) // 33 as least from c)
 select cast(bin as bigint) as bin, n, cast(case when n < least then greatest(bin - 1, 0) else bin end as bigint) as merged from c, t""")
def small_bins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 1000
    c = table(spark, d, "orders").groupBy(sum((k >= t).cast("int") for t in (10, 30, 100, 300)).alias("bin")).agg(F.count("*").alias("n")).collect()
    place = drift.merge_small_bins([(r.bin, r.n) for r in c], sum(r.n for r in c) // 33)
    return spark.createDataFrame([(r.bin, r.n, place[r.bin]) for r in c], "bin long, n long, merged long")


@query("select a.o_orderkey, b.c_custkey from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) r from orders where o_orderkey in (select o_orderkey from orders order by o_orderkey limit 100)) a join (select c_custkey, row_number() over (order by c_acctbal, c_custkey) r from (select * from customer order by c_custkey limit 100)) b using (r)")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")
    b = table(spark, d, "customer").orderBy("c_custkey").limit(100).select("c_custkey", "c_acctbal")
    return join.positional_join(a, b, ["o_totalprice", "o_orderkey"], ["c_acctbal", "c_custkey"]).select("o_orderkey", "c_custkey")


@query(f'with {CASES} select case_id, row_number() over (order by week_num, weekday_decision, case_id) as row from cases')
def stable_order(spark: SparkSession, d: str) -> DataFrame:
    return join.number_rows(cases(spark, d).select("case_id", "WEEK_NUM", "weekday_decision"), ["WEEK_NUM", "weekday_decision", "case_id"], "row").select("case_id", F.col("row").cast("bigint").alias("row"))


@query(f"with {CASES}, r as (select week_num < lag(week_num) over (order by case_id) as down from cases) select cast(count(*) filter (down) as bigint) as n from r")
def sortedness(spark: SparkSession, d: str) -> DataFrame:
    x = join.number_rows(cases(spark, d).select("case_id", "WEEK_NUM"), ["case_id"], "row")
    return prepare.inversions(x, "row", "WEEK_NUM")


@query(f"with {CASES} select case_id, cast(target as bigint) as target, 'val' as split from val union all select case_id, cast(target as bigint), 'test' from test")
def val_and_test(spark: SparkSession, d: str) -> DataFrame:
    _, val, test = splits(spark, d)
    return tidy(val.withColumn("split", F.lit("val")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True).select("case_id", "target", "split"))


_S = "(l_tax - 0.03e0) * (l_quantity - 20e0)"
_SIDE = "base as (select * from lineitem where l_orderkey % 3 = 0), other as (select * from lineitem where l_orderkey % 3 = 1)"


def _contributions(spark: SparkSession, d: str, side: int) -> DataFrame:
    x = lines(spark, d).where(F.col("case_id") % 3 == side)
    return x.withColumn("s", (F.col("tax_4P") - 0.03) * (F.col("quantity_1P") - 20.0)).withColumn("x", F.col("quantity_1P") - 25.0)


@query(
    f"""with {_SIDE}, q as (select list_sort(list_distinct(list_append(quantile_cont(l_quantity - 25, [i / 10e0 for i in range(0, 11)]), 0e0))) as e from base), f as (select e[2:len(e) - 1] as e from q),
 a as (select len(list_filter(e, lambda t: t < l_quantity - 25)) as bin, count(*) n, avg(l_quantity - 25) mx, avg({_S}) ms from base, f group by 1), b as (select len(list_filter(e, lambda t: t < l_quantity - 25)) as bin, count(*) n, avg(l_quantity - 25) mx, avg({_S}) ms from other, f group by 1),
 j as (select coalesce(a.bin, b.bin) as bin, a.n as n_base, a.mx as mean_x_base, a.ms as mean_s_base, b.n as n_other, b.mx as mean_x_other, b.ms as mean_s_other, coalesce(a.n, 0) >= 30 as p, coalesce(b.n, 0) >= 30 as q from a full join b on a.bin = b.bin)
 select cast(bin as bigint) as bin, n_base, {R('mean_x_base')} as mean_x_base, {R('mean_s_base')} as mean_s_base, n_other, {R('mean_x_other')} as mean_x_other, {R('mean_s_other')} as mean_s_other from j where case when (select bool_or(p and q) from j) then p and q else p or q end"""
)
def dependence_bins(spark: SparkSession, d: str) -> DataFrame:
    return tidy(model.dependence(_contributions(spark, d, 0), _contributions(spark, d, 1), "x", "s"))


@query(
    f"""with {_SIDE}, a as (select l_returnflag as level, count(*) n, avg({_S}) s from base group by 1), b as (select l_returnflag as level, count(*) n, avg({_S}) s from other group by 1),
 l as (select level, dense_rank() over (order by level) - 1 as code from (select level from a union select level from b))
 select l.level, cast(code as bigint) as code, a.n as n_base, {R('a.s')} as mean_s_base, b.n as n_other, {R('b.s')} as mean_s_other from l left join a using (level) left join b using (level) where coalesce(a.n, 0) >= 30 or coalesce(b.n, 0) >= 30"""
)
def dependence_levels(spark: SparkSession, d: str) -> DataFrame:
    return tidy(model.category_dependence(_contributions(spark, d, 0), _contributions(spark, d, 1), "returnflag_5M", "s"))


@query(" union all ".join(f"select l_linenumber as line, '{n}' as feature, {R(f'avg(abs({x}))')} as shap from lineitem group by 1" for n, x in (("tax", "l_tax - 0.04e0"), ("quantity", "25e0 - l_quantity"))))
def contribution_means(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).select(F.col("num_group1").cast("int").alias("line"), (F.col("tax_4P") - 0.04).alias("tax"), (25.0 - F.col("quantity_1P")).alias("quantity"))
    return tidy(model.mean_abs(x, ["tax", "quantity"], ["line"])).select(F.col("line").cast("int").alias("line"), "feature", "shap")


#: One tree of depth 1 on one yes-or-no feature: its leaves are weighted means of a target of 1 and -1.
_STUMP = f"""{CASES}, w as (select greatest(1, sum(1 - target) / sum(target)::double) as w from train), leaf as (select y_prob > 0.5 as up, sum(case when target = 1 then w else -1 end) / sum(case when target = 1 then w else 1 end) as v, sum(case when target = 1 then w else 1 end) as n from train, w group by 1),
 mean as (select sum(v * n) / sum(n) as m from leaf)"""


def _stump(spark: SparkSession, d: str) -> tuple[model.Boosted, DataFrame]:
    x = cases(spark, d).select("case_id", "WEEK_NUM", "target", (F.col("y_prob") > 0.5).cast("double").alias("up"), F.lit(1.0).alias("flat"))
    return model.Boosted.fit(x.where(F.col("WEEK_NUM") <= WEEKS.train_end), ["up", "flat"], rounds=1, depth=1), x.where(F.col("WEEK_NUM") > WEEKS.val_end)


_PREDICTED = f"with {_STUMP} select case_id, week_num as \"WEEK_NUM\", cast(target as bigint) as target, {R('1 / (1 + exp(-2 * v))')} as y_prob from test join leaf on up = (y_prob > 0.5)"


@query(_PREDICTED)
def tree_predict(spark: SparkSession, d: str) -> DataFrame:
    m, x = _stump(spark, d)
    return tidy(m.predict(x))


@query(_PREDICTED)
def tree_saved_and_loaded(spark: SparkSession, d: str) -> DataFrame:
    m, x = _stump(spark, d)
    path = scratch(spark, "model")
    m.save(path)
    return tidy(model.Boosted.load(spark, path).predict(x))


@query("select 'up' as feature, 1e0 as gain union all select 'flat', 0e0")
def tree_gain(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_stump(spark, d)[0].gain(spark))


@query(f"with {_STUMP} select case_id, {R('v - m')} as up, 0e0 as flat from test join leaf on leaf.up = (y_prob > 0.5), mean")
def tree_contributions(spark: SparkSession, d: str) -> DataFrame:
    m, x = _stump(spark, d)
    return tidy(m.contributions(x, ["case_id"]))


@query(f"with {_STUMP} select week_num as \"WEEK_NUM\", f as feature, {R('avg(case when f = $$up$$ then abs(v - m) else 0 end)')} as shap from test join leaf on leaf.up = (y_prob > 0.5), mean, (select unnest(['up', 'flat']) as f) group by 1, 2")
def tree_weekly_contributions(spark: SparkSession, d: str) -> DataFrame:
    m, x = _stump(spark, d)
    return tidy(model.mean_abs(m.contributions(x), ["up", "flat"], ["WEEK_NUM"]))


@query(f"with {CASES} select case_id, week_num as \"WEEK_NUM\", cast(target as bigint) as target, cast(y_prob > 0.5 as bigint) as up from test")
def tree_selector(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", "WEEK_NUM", "target", (F.col("y_prob") > 0.5).cast("double").alias("up"), F.lit(1.0).alias("flat"), F.lit(0.0).alias("level"))
    s, _, test = prepare.time_split(x, WEEKS).values()
    made = model.GainShapSelector.fit(s, ["up", "flat", "level"], 1, 1, rounds=1).transform(test)
    return tidy(made.withColumn("up", F.col("up").cast("int")))


@query(
    f"""with {CASES}, g as (select avg(target) as gm from train), r as (select *, row_number() over (partition by priority_1m order by week_num, weekday_decision, case_id) as i from train),
 k as (select priority_1m as level, sum(target)::double as s, count(*) as c, avg(target) filter (i > n - 100) as recent from (select *, count(*) over (partition by priority_1m) as n from r) group by 1)
 select level, {R('s')} as s, c, {R('recent')} as recent from k"""
)
def encoder_state(spark: SparkSession, d: str) -> DataFrame:
    s = prepare.encoder_state(splits(spark, d)[0], "priority_1M", ["WEEK_NUM", "weekday_decision", "case_id"])
    return tidy(s.select("level", "s", "c", (F.aggregate("tail", F.lit(0.0), lambda a, v: a + v) / F.size("tail")).alias("recent")))
