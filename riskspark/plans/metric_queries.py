"""Queries on scores: ranking, calibration, drift, business curves, conformal sets, selection and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.numeric import clip
from riskspark.operators import business, calibrate, conformal, drift, join, metrics, model, select

from .cases import CAPS, CASES, LINE_ORDER, R, WEEKS, cases, lines, query, splits, table, tidy

BLOCK = 13
_BLOCKED = f"{CASES}, blocks as (select *, week_num // {BLOCK} as block from cases)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Cases under blocks of 13 weeks, so that groups are large enough at every scale."""
    return cases(spark, d).withColumn("block", F.floor(F.col("WEEK_NUM") / BLOCK).cast("bigint"))


def _ranking_sql(source: str, keys: str = "") -> str:
    k, by, part = (f"{keys}, ", f"group by {keys}", f"partition by {keys}") if keys else ("", "", "")
    return f"""h as (select {k}y_prob as s, cast(sum(target) as double) as pos, cast(sum(1 - target) as double) as neg from {source} group by {k}y_prob),
 c as (select {k}s, pos, neg, sum(pos) over (partition by {keys or "1"} order by s desc) as tp, sum(neg) over (partition by {keys or "1"} order by s desc) as fp, sum(pos) over ({part}) as p, sum(neg) over ({part}) as n from h),
 m as (select {k}sum(pos + neg) as cnt, max(p) as p, max(n) as n, sum(neg * (tp - pos + pos / 2e0)) as u, sum(pos * tp / (tp + fp)) as a, max(abs(tp / nullif(p, 0) - fp / nullif(n, 0))) as ks from c {by})"""


def _metric(expr: str) -> str:
    return R(f"case when p > 0 and n > 0 then {expr} end")


@query(f"with {CASES}, {_ranking_sql('val')} select {_metric('u / (p * n)')} as roc_auc from m")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(splits(spark, d)[1]).select("roc_auc"))


@query(f"with {CASES}, {_ranking_sql('val')} select {_metric('a / p')} as pr_auc from m")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(splits(spark, d)[1]).select("pr_auc"))


@query(f"with {CASES}, {_ranking_sql('test')} select {_metric('ks')} as ks from m")
def ks_score(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(splits(spark, d)[2]).select("ks"))


@query(f"with {_BLOCKED}, {_ranking_sql('blocks', 'block')} select block, cast(cnt as bigint) as n, {R('p / cnt')} as pos_rate, {_metric('a / p')} as pr_auc, {_metric('u / (p * n)')} as roc_auc, {_metric('ks')} as ks from m")
def weekly_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(_blocks(spark, d), ["block"]))


_EDGES = "[i * 0.05e0 for i in range(0, 21)]"
_SCORE_BIN = "greatest(1, len(list_filter([i * 0.05e0 for i in range(0, 21)], lambda t: t < y_prob)))"


@query(f"with {CASES}, b as (select {_SCORE_BIN} as bin, y_prob, target from test) select cast(bin as bigint) as bin, {R('avg(y_prob)')} as mean_p, {R('avg(target)')} as mean_y, count(*) as n from b group by 1")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.reliability(splits(spark, d)[2]))


@query(
    f"""with {CASES}, b as (select {_SCORE_BIN} as bin, y_prob, target from test), g as (select bin, count(*) c, avg(y_prob) mp, avg(target) my, sum((y_prob - target) * (y_prob - target)) e from b group by 1)
 select {R('sum(e) / sum(c)')} as brier, {R('sum(c * abs(my - mp)) / sum(c)')} as ece from g"""
)
def brier_ece(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.calibration_error(splits(spark, d)[2]))


@query(
    f"""with {CASES}, {_ranking_sql('test')}, b as (select {_SCORE_BIN} as bin, y_prob, target from test), g as (select bin, count(*) c, avg(y_prob) mp, avg(target) my, sum((y_prob - target) * (y_prob - target)) e from b group by 1),
 e as (select sum(e) / sum(c) as brier, sum(c * abs(my - mp)) / sum(c) as ece from g)
 select cast(cnt as bigint) as n, {R('p / cnt')} as pos_rate, {_metric('a / p')} as pr_auc, {_metric('u / (p * n)')} as roc_auc, {_metric('ks')} as ks, {R('brier')} as brier, {R('ece')} as ece from m, e"""
)
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.summary(splits(spark, d)[2]))


_CAL = "y_prob * y_prob"


@query(
    f"""with {CASES}, q as (select unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as q, unnest(quantile_cont(y_prob, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) as a, unnest(quantile_cont({_CAL}, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) as b from test),
 t as (select corr(y_prob, {_CAL}) as c, avg(abs({_CAL} - y_prob)) as m from test)
 select {R('q')} as q, {R('a')} as raw, {R('b')} as cal, {R('b - a')} as diff, {R('c')} as corr, {R('m')} as mean_abs from q, t"""
)
def prob_shift_quantiles(spark: SparkSession, d: str) -> DataFrame:
    x = splits(spark, d)[2]
    return tidy(metrics.prediction_shift(x.withColumn("y_prob_cal", F.col("y_prob") * F.col("y_prob"))))


@query(
    f"""with {_BLOCKED}, a as (select block, count(*) n, avg(target) r from blocks where block < 20 group by 1), b as (select block, avg((y_prob - target) * (y_prob - target)) e from blocks where block > 5 group by 1)
 select coalesce(a.block, b.block) as block, n as n_raw, {R('r')} as rate_raw, {R('e')} as brier_cal from a full join b on a.block = b.block"""
)
def raw_cal_weekly_outer(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d)
    a = x.where("block < 20").groupBy("block").agg(F.count("*").alias("n"), F.avg("target").alias("rate"))
    b = x.where("block > 5").groupBy("block").agg(F.avg(F.pow(F.col("y_prob") - F.col("target"), 2)).alias("brier"))
    return tidy(metrics.weekly_raw_and_calibrated(a, b, "block"))


def _qs(bins: int) -> str:
    return "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"


def _psi_sql(base: str, other: str, x: str, bins: int, keys: str = "", edges: str | None = None) -> str:
    """CTEs up to `d`: a row a group and bin with expected and actual rates."""
    k, on = (f"{keys}, ", f"and o.{keys} = g.{keys}") if keys else ("", "")
    return f"""e as ({edges or f"select quantile_cont({x}, {_qs(bins)}) as e from {base}"}),
 b as (select len(list_filter(e, lambda t: t <= {x})) as bin, count(*) as c from {base}, e where {x} is not null group by 1),
 o as (select {k}len(list_filter(e, lambda t: t <= {x})) as bin, count(*) as c from {other}, e where {x} is not null group by {"1, 2" if keys else "1"}),
 g as (select {k}cast(sum(c) as bigint) as t from o {f"group by {keys}" if keys else ""}),
 s as (select unnest(range(0, {bins})) as bin),
 d as (select {f"g.{keys}, " if keys else ""}s.bin, g.t, coalesce(b.c, 0) / (select sum(c) from b)::double as ex, coalesce(o.c, 0) / greatest(1, g.t)::double as ac
  from g cross join s left join b on b.bin = s.bin left join o on o.bin = s.bin {on})"""


_TERM = "(ac - ex) * ln((ac + 1e-6) / (ex + 1e-6))"


@query(f"with {CASES}, {_psi_sql('train', 'test', 'y_prob', 10)} select cast(max(t) as bigint) as n, {R(f'sum({_TERM})')} as psi from d")
def psi_score(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.psi(train, test, "y_prob"))


@query(f"with {CASES}, {_psi_sql('train', 'test', 'price_1a', 10)} select cast(bin as bigint) as bin, {R('ex')} as exp_rate, {R('ac')} as act_rate, cast(t as bigint) as n, {R(_TERM)} as contrib from d")
def psi_bins(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.psi_bins(train, test, "price_1A"))


@query(
    f"""with {CASES}, a as (select priority_1m l, count(*) c from train group by 1), b as (select priority_1m l, count(*) c from test group by 1),
 r as (select a.c / sum(a.c) over ()::double as ex, coalesce(b.c, 0) / sum(coalesce(b.c, 0)) over ()::double as ac from a left join b using (l)) select {R(f'sum({_TERM})')} as psi from r"""
)
def psi_categorical(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.psi_categorical(train, test, "priority_1M"))


@query(f"with {_BLOCKED}, {_psi_sql('train', 'blocks', 'y_prob', 20, 'block')} select block, cast(max(t) as bigint) as n, {R(f'case when max(t) >= 30 then sum({_TERM}) end')} as psi from d group by 1")
def weekly_psi(spark: SparkSession, d: str) -> DataFrame:
    return tidy(drift.weekly_psi(splits(spark, d)[0], _blocks(spark, d), week="block"))


@query(
    " union all ".join(
        f"(with {_BLOCKED}, {_psi_sql('train', 'blocks', x, 10, 'block')} select '{n}' as feature, block, cast(max(t) as bigint) as n, {R(f'case when max(t) >= 30 then sum({_TERM}) end')} as psi from d group by 2)" for n, x in (("y_prob", "y_prob"), ("price_1A", "price_1a"))
    )
)
def weekly_feature_psi(spark: SparkSession, d: str) -> DataFrame:
    return tidy(drift.weekly_feature_psi(splits(spark, d)[0], _blocks(spark, d), ["y_prob", "price_1A"], week="block"))


@query(
    "select feature, "
    + R("median(psi)")
    + " as median_psi, "
    + R("max(psi)")
    + " as max_psi from ("
    + " union all ".join(f"(with {_BLOCKED}, {_psi_sql('train', 'blocks', x, 10, 'block')} select '{n}' as feature, case when max(t) >= 30 then sum({_TERM}) end as psi from d group by block)" for n, x in (("y_prob", "y_prob"), ("price_1A", "price_1a")))
    + ") group by 1"
)
def weekly_feature_psi_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(drift.psi_summary(drift.weekly_feature_psi(splits(spark, d)[0], _blocks(spark, d), ["y_prob", "price_1A"], week="block")))


def _ks_sql(a: str, b: str, x: str) -> str:
    return f"""u as (select v, sum(a) a, sum(b) b from (select {x} v, 1 a, 0 b from {a} union all select {x}, 0, 1 from {b}) group by v),
 k as (select sum(a) over (order by v) / sum(a) over ()::double - sum(b) over (order by v) / sum(b) over ()::double as g from u)"""


@query(f"with {CASES}, {_ks_sql('train', 'test', 'price_1a')} select {R('max(abs(g))')} as ks from k")
def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.ks_two_sample(train, test, "price_1A"))


def _iv_sql(name: str, of: str, x: str, bins: int) -> str:
    return f"""{name}e as (select quantile_cont({x}, {_qs(bins)}) as e from train), {name}c as (select len(list_filter(e, lambda t: t < {x})) as bin, sum(1 - target) good, sum(target) bad from {of}, {name}e group by 1),
 {name}r as (select (coalesce(good, 0) + 1e-6) / (sum(coalesce(good, 0)) over () + 1e-6 * {bins}) as g, (coalesce(bad, 0) + 1e-6) / (sum(coalesce(bad, 0)) over () + 1e-6 * {bins}) as b from (select unnest(range(0, {bins})) as bin) left join {name}c using (bin)),
 {name} as (select sum((g - b) * ln(g / b)) as iv from {name}r)"""


@query(f"with {CASES}, {_iv_sql('v', 'test', 'price_1a', 10)} select {R('iv')} as iv from v")
def iv_numeric(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.iv_numeric(test, "price_1A", drift.quantile_edges(train, "price_1A", 10)))


@query(
    f"""with {CASES}, l as (select distinct priority_1m p from train), c as (select priority_1m p, sum(1 - target) good, sum(target) bad from test group by 1), t as (select sum(good) tg, sum(bad) tb from c), n as (select count(*) k from l),
 r as (select (coalesce(good, 0) + 1e-6) / (tg + 1e-6 * k) g, (coalesce(bad, 0) + 1e-6) / (tb + 1e-6 * k) b from l left join c using (p), t, n) select {R('sum((g - b) * ln(g / b))')} as iv from r"""
)
def iv_categorical(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = splits(spark, d)
    return tidy(drift.iv_categorical(train, test, "priority_1M"))


@query(
    f"""with {CASES}, r as (select target, row_number() over (order by price_1a, case_id) as r, count(*) over () as n from train),
 b as (select target, len(list_filter([1 + (n - 1) * (i / 10e0) for i in range(1, 10)], lambda t: t < r)) as bin from r),
 c as (select bin, sum(target) bad, sum(1 - target) good from b group by 1), p as (select bad / sum(bad) over ()::double b, good / sum(good) over ()::double g from c)
 select {R('sum((b - g) * ln((b + 1e-6) / (g + 1e-6)))')} as iv from p"""
)
def iv_qcut(spark: SparkSession, d: str) -> DataFrame:
    iv = drift.iv_qcut(splits(spark, d)[0], "price_1A", ["case_id"])
    return tidy(spark.createDataFrame([(iv,)], "iv double"))


def _stability_sql() -> str:
    cells = []
    for n, x in (("y_prob", "y_prob"), ("price_1A", "price_1a")):
        p = {k: f"(with {_psi_sql('train', k, x, 10)} select sum({_TERM}) from d)" for k in ("val", "test")}
        ks = {k: f"(with {_ks_sql('train', k, x)} select max(abs(g)) from k)" for k in ("val", "test")}
        iv = {k: f"(with {_iv_sql('v', k, x, 10)} select iv from v)" for k in ("train", "val", "test")}
        cells.append(f"select '{n}' as feature, {p['val']} pv, {p['test']} pt, {ks['val']} kv, {ks['test']} kt, {iv['train']} ia, {iv['val']} ib, {iv['test']} ic")
    return f"with {CASES}, z as ({' union all '.join(cells)}) select feature, {R('pv')} as psi_train_to_val, {R('pt')} as psi_train_to_test, {R('kv')} as ks_train_vs_val, {R('kt')} as ks_train_vs_test, {R('ia')} as iv_train, {R('ib')} as iv_val, {R('ic')} as iv_test, {R('ib - ia')} as iv_val_minus_train, {R('ic - ia')} as iv_test_minus_train from z"


@query(_stability_sql())
def stability_table(spark: SparkSession, d: str) -> DataFrame:
    return tidy(drift.stability_table(*splits(spark, d), ["y_prob", "price_1A"]))


@query(f"with {CASES} select {R('avg(target)')} as base_bad_rate from val")
def base_bad_rate(spark: SparkSession, d: str) -> DataFrame:
    return tidy(business.base_bad_rate(splits(spark, d)[1]))


@query(
    f"""with {CASES}, g as (select i * 0.005e0 as t from range(0, 201) r(i)) select {R('t')} as threshold, {R('count(*) filter (y_prob <= t) / count(*)::double')} as approval_rate,
 {R('avg(target) filter (y_prob <= t)')} as bad_rate_in_approved, count(*) filter (y_prob <= t) as n_approved from val, g group by t"""
)
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return tidy(business.threshold_curve(splits(spark, d)[1]))


@query(
    f"""with {CASES}, r as (select target, row_number() over (order by y_prob desc, case_id) as r, count(*) over () as n from val), k as (select unnest([0.05e0, 0.10e0, 0.15e0]) as k)
 select {R('k')} as k, cast(max(greatest(1, floor(n * k))) as bigint) as top_n, {R('sum(target) filter (r <= greatest(1, floor(n * k))) / max(greatest(1, floor(n * k)))')} as precision_at_k,
 {R('sum(target) filter (r <= greatest(1, floor(n * k))) / sum(target)::double')} as recall_at_k from r, k group by k"""
)
def pr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return tidy(business.precision_at(splits(spark, d)[1]))


@query(
    f"""with {CASES}, r as (select target, ntile(20) over (order by y_prob desc, case_id) as b from val), g as (select b, count(*) c, sum(target) p from r group by 1),
 w as (select b, sum(c) over (order by b) n, sum(p) over (order by b)::double cp, sum(c) over () t, sum(p) over ()::double tp from g)
 select cast(b as bigint) as bin_idx, cast(n as bigint) as cum_n, {R('cp / tp')} as cum_recall, {R('(cp / n) / (tp / t)')} as lift from w"""
)
def lift_curve(spark: SparkSession, d: str) -> DataFrame:
    return tidy(business.lift_curve(splits(spark, d)[1]))


_CAP_SQL = """h as (select y_prob s, count(*) c, sum(target) b from val group by 1), cu as (select s, sum(c) over (order by s) k, sum(b) over (order by s) / sum(c) over (order by s)::double r, sum(c) over () t from h),
 caps as (select unnest([0.1e0, 0.15e0, 0.2e0]) as cap), pick as (select cap, max(s) as thr, max(k) as k, arg_max(r, s) as r, max(t) as t from cu, caps where r <= cap group by 1)"""


@query(f"with {CASES}, {_CAP_SQL} select {R('cap')} as bad_cap, {R('thr')} as threshold, {R('k / t::double')} as approve_rate, {R('r')} as bad_rate from pick")
def bad_cap_threshold(spark: SparkSession, d: str) -> DataFrame:
    return tidy(business.threshold_under_cap(splits(spark, d)[1], CAPS))


@query(
    f"""with {_BLOCKED}, ok as (select * from train where y_prob <= 0.5e0), okb as (select * from blocks where y_prob <= 0.5e0), {_psi_sql('ok', 'okb', 'y_prob', 10, 'block')},
 p as (select block, case when max(t) >= 30 then sum({_TERM}) end as psi from d group by 1),
 wk as (select block, count(*) n, avg(cast(y_prob <= 0.5e0 as integer)) ar, avg(target) filter (y_prob <= 0.5e0) br, sum(target) filter (y_prob > 0.5e0) rb, sum(target) tb from blocks group by 1)
 select wk.block, n, {R('ar')} as approve_rate, {R('br')} as bad_rate_in_approved, {R('coalesce(rb, 0) / nullif(tb, 0)::double')} as bad_capture_rate, {R('psi')} as psi from wk left join p using (block)"""
)
def weekly_stability(spark: SparkSession, d: str) -> DataFrame:
    base = splits(spark, d)[0].where("y_prob <= 0.5")
    return tidy(business.weekly_stability(_blocks(spark, d), 0.5, base, drift.quantile_edges(base, "y_prob", 10), week="block"))


def _strategy_sql() -> str:
    part = lambda n: f"""{n}o as (select cap, thr, avg(cast(y_prob <= thr as integer)) ar, avg(target) filter (y_prob <= thr) br, count(*) filter (y_prob <= thr) n, coalesce(sum(target) filter (y_prob > thr), 0) / greatest(1, sum(target))::double cr from {n}, pick group by 1, 2),
 {n}w as (select cap, week_num, avg(target) filter (y_prob <= thr) br from {n}, pick group by 1, 2), {n}s as (select cap, avg(cast(coalesce(br > cap, false) as integer)) over_, max(br) worst, stddev_pop(br) sd from {n}w group by 1)"""  # noqa: E731
    return f"""with {CASES}, {_CAP_SQL}, {part('val')}, {part('test')},
 ed as (select cap, thr, quantile_cont(y_prob, {_qs(10)}) e from val, pick where y_prob <= thr group by 1, 2),
 vb as (select cap, len(list_filter(e, lambda t: t <= y_prob)) bin, count(*) c from val, ed where y_prob <= thr group by 1, 2),
 tb as (select cap, week_num, len(list_filter(e, lambda t: t <= y_prob)) bin, count(*) c from test, ed where y_prob <= thr group by 1, 2, 3),
 sp as (select cap, unnest(range(0, 10)) as bin from pick), vr as (select sp.cap, sp.bin, coalesce(c, 0) / sum(coalesce(c, 0)) over (partition by sp.cap)::double ex from sp left join vb on vb.cap = sp.cap and vb.bin = sp.bin),
 tw as (select cap, week_num, sum(c) t from tb group by 1, 2), wk as (select tw.cap, tw.week_num, max(t) t, sum((coalesce(c, 0) / t::double - ex) * ln((coalesce(c, 0) / t::double + 1e-6) / (ex + 1e-6))) psi from tw join vr on vr.cap = tw.cap left join tb on tb.cap = tw.cap and tb.week_num = tw.week_num and tb.bin = vr.bin group by 1, 2),
 ws as (select cap, median(case when t >= 30 then psi end) med, max(case when t >= 30 then psi end) mx from wk group by 1),
 ta as (select cap, bin, sum(c) c from tb group by 1, 2), tt as (select cap, sum(c) t from ta group by 1), al as (select vr.cap, sum((coalesce(c, 0) / t::double - ex) * ln((coalesce(c, 0) / t::double + 1e-6) / (ex + 1e-6))) psi from vr join tt on tt.cap = vr.cap left join ta on ta.cap = vr.cap and ta.bin = vr.bin group by 1)
 select {R('v.cap')} as bad_cap, {R('v.thr')} as threshold, {R('v.ar')} as val_approve_rate, {R('v.br')} as val_bad_rate_in_approved, v.n as val_approved_n, {R('v.cr')} as val_bad_capture_rate,
 {R('vs.over_')} as val_share_weeks_over_cap, {R('vs.worst')} as val_worst_week_bad, {R('vs.sd')} as val_std_bad, {R('t.ar')} as test_approve_rate, {R('t.br')} as test_bad_rate_in_approved, t.n as test_approved_n,
 {R('t.cr')} as test_bad_capture_rate, {R('ts.over_')} as test_share_weeks_over_cap, {R('ts.worst')} as test_worst_week_bad, {R('ts.sd')} as test_std_bad, {R('ws.med')} as test_median_week_psi, {R('ws.mx')} as test_max_week_psi, {R('al.psi')} as test_overall_psi
 from valo v join testo t using (cap) join vals vs using (cap) join tests ts using (cap) left join ws using (cap) left join al using (cap)"""


@query(_strategy_sql())
def strategy_table(spark: SparkSession, d: str) -> DataFrame:
    _, val, test = splits(spark, d)
    return tidy(business.strategy_table(val, test, CAPS))


_SYM = "case when target = 1 then 1e0 - y_prob else y_prob end"
_LL = "case when target = 1 then -ln(least(greatest(y_prob, 1e-12), 1 - 1e-12)) else -ln(1e0 - least(greatest(y_prob, 1e-12), 1 - 1e-12)) end"
_LL0, _LL1 = "-ln(1e0 - least(greatest(y_prob, 1e-12), 1 - 1e-12))", "-ln(least(greatest(y_prob, 1e-12), 1 - 1e-12))"
_A = repr(1 - 0.05)
_RATES = f"{R('avg(cast(size = 0 as integer))')} as empty_rate, {R('avg(cast(size = 1 as integer))')} as singleton_rate, {R('avg(cast(size = 2 as integer))')} as ambiguity_rate, {R('avg(size)')} as avg_set_size"
_COVER = f"count(*) as n, {R('avg(hit)')} as coverage, {_RATES}, count(*) filter (target = 0) as n_y0, {R('avg(hit) filter (target = 0)')} as coverage_y0, count(*) filter (target = 1) as n_y1, {R('avg(hit) filter (target = 1)')} as coverage_y1"
_SETS = "cast(case when target = 1 then i1 else i0 end as integer) as hit, cast(i0 as integer) + cast(i1 as integer) as size"
#: Blocks stand for weeks: targets from block 22 on, six blocks before each, and the blocks 19 to 21 as the fixed set.
_FIRST, _VAL = 22, (19, 21)
_PAIRS = f"tg as (select distinct block as wk from blocks where block >= {_FIRST}), cal as (select wk, target, y_prob from blocks, tg where block between wk - 6 and wk - 1)"


def _rolling(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = _blocks(spark, d).select("case_id", "block", "target", "y_prob")
    return x, x.where(F.col("block").between(*_VAL))


@query(
    f"""with {CASES}, c as (select {_SYM} as s from val), n as (select count(*) n from c), r as (select s, row_number() over (order by s) r from c), q as (select n, min(s) q from r, n where r >= least(n, ceil((n + 1) * {_A})) group by 1),
 x as (select *, y_prob <= q as i0, 1e0 - y_prob <= q as i1 from test, q), y as (select *, {_SETS} from x)
 select 0.05e0 as alpha, max(n) as n_val, {R('max(q)')} as q, {R('1 - max(q)')} as q_low, {R('max(q)')} as q_high, {R('avg(hit)')} as test_coverage, {_RATES} from y"""
)
def conformal_split(spark: SparkSession, d: str) -> DataFrame:
    _, val, test = splits(spark, d)
    return tidy(conformal.split_conformal(val, test), "alpha")


@query(f"with {_BLOCKED}, {_PAIRS}, q as (select wk, quantile_cont({_SYM}, {_A}) q from cal group by 1), x as (select *, y_prob <= q as i0, 1e0 - y_prob <= q as i1 from blocks join q on wk = block), y as (select *, {_SETS} from x) select block, {R('max(q)')} as q, {_COVER} from y group by 1")
def conformal_rolling_sym(spark: SparkSession, d: str) -> DataFrame:
    return tidy(conformal.rolling_symmetric(_rolling(spark, d)[0], _FIRST, week="block"))


_GLOBAL = f"gl as (select quantile_cont({_LL}, {_A}) filter (target = 0) g0, quantile_cont({_LL}, {_A}) filter (target = 1) g1 from blocks where block between {_VAL[0]} and {_VAL[1]})"


@query(
    f"""with {_BLOCKED}, {_PAIRS}, {_GLOBAL}, q as (select wk, count(*) filter (target = 0) n0, count(*) filter (target = 1) n1, quantile_cont({_LL}, {_A}) filter (target = 0) a0, quantile_cont({_LL}, {_A}) filter (target = 1) a1 from cal group by 1),
 p as (select wk, case when n0 < 20 then g0 else a0 end q0, case when n1 < 20 then g1 else a1 end q1, cast(n0 < 20 as integer) f0, cast(n1 < 20 as integer) f1 from q, gl),
 x as (select *, {_LL0} <= q0 as i0, {_LL1} <= q1 as i1 from blocks join p on wk = block), y as (select *, {_SETS} from x)
 select block, {R('max(q0)')} as q0, {R('max(q1)')} as q1, cast(max(f0) as bigint) as fallback_q0, cast(max(f1) as bigint) as fallback_q1, {_COVER} from y group by 1"""
)
def conformal_rolling_mondrian(spark: SparkSession, d: str) -> DataFrame:
    x, val = _rolling(spark, d)
    return tidy(conformal.rolling_mondrian(x, val, _FIRST, week="block"))


@query(
    f"""with {_BLOCKED}, {_PAIRS}, {_GLOBAL}, ed as (select wk, quantile_cont(y_prob, {_qs(5)}) e from cal group by 1), cb as (select cal.wk, target, y_prob, len(list_filter(e, lambda t: t < y_prob)) bin from cal join ed on ed.wk = cal.wk),
 q as (select wk, bin, count(*) n, count(*) filter (target = 0) n0, count(*) filter (target = 1) n1, quantile_cont({_LL}, {_A}) filter (target = 0) a0, quantile_cont({_LL}, {_A}) filter (target = 1) a1 from cb group by 1, 2),
 s as (select wk, unnest(range(0, 5)) bin from ed), f as (select s.wk, s.bin, coalesce(n, 0) < 200 thin, n0 < 20 t0, n1 < 20 t1, a0, a1, g0, g1 from s left join q on q.wk = s.wk and q.bin = s.bin, gl),
 p as (select wk, bin, thin, not thin and t0 as f0, not thin and t1 as f1, case when thin or t0 then g0 else a0 end q0, case when thin or t1 then g1 else a1 end q1 from f),
 fr as (select wk, avg(cast(thin as integer)) fb, avg(cast(f0 as integer)) r0, avg(cast(f1 as integer)) r1 from p group by 1),
 tb as (select blocks.*, wk, len(list_filter(e, lambda t: t < y_prob)) bin from blocks join ed on wk = block), x as (select tb.*, {_LL0} <= q0 as i0, {_LL1} <= q1 as i1 from tb join p on p.wk = tb.wk and p.bin = tb.bin), y as (select *, {_SETS} from x)
 select block, {_COVER}, {R('max(fb)')} as fallback_bin_rate, {R('max(r0)')} as fallback0_rate, {R('max(r1)')} as fallback1_rate from y join fr on fr.wk = block group by 1"""
)
def conformal_rolling_binned(spark: SparkSession, d: str) -> DataFrame:
    x, val = _rolling(spark, d)
    return tidy(conformal.rolling_binned(x, val, _FIRST, week="block"))


_WEIGHT = "(1 + case_id % 7)"


@query(
    f"""with {_BLOCKED}, tg as (select distinct block as wk from blocks where block >= {_FIRST}), cal as (select wk, {_SYM} s, {_WEIGHT} w from blocks, tg where block between wk - 6 and wk - 1),
 v as (select wk, s, sum(w) w from cal group by 1, 2), c as (select wk, s, sum(w) over (partition by wk order by s) cw, sum(w) over (partition by wk) tw from v), q as (select wk, min(s) filter (cw >= {_A} * tw) q from c group by 1),
 x as (select *, y_prob <= q as i0, 1e0 - y_prob <= q as i1 from blocks join q on wk = block), y as (select *, {_SETS} from x) select block, {R('max(q)')} as q, {_COVER} from y group by 1"""
)
def conformal_rolling_weighted(spark: SparkSession, d: str) -> DataFrame:
    x = _rolling(spark, d)[0].withColumn("w", 1 + F.col("case_id") % 7)
    return tidy(conformal.rolling_symmetric(x, _FIRST, weight="w", week="block"))


@query(
    f"""with {_BLOCKED}, v as (select block, price_1a s, sum({_WEIGHT}) w from blocks group by 1, 2), c as (select block, s, sum(w) over (partition by block order by s) cw, sum(w) over (partition by block) tw from v)
 select block, {R('min(s) filter (cw >= 0.9e0 * tw)')} as q from c group by 1"""
)
def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).withColumn("w", 1 + F.col("case_id") % 7)
    return tidy(conformal.weighted_quantile(x, "price_1A", "w", 0.9, ["block"]))


_MEAN = lambda x, n: f"{R(f'case when count({x}) = count(*) then sum({x} * {n}) / sum({n}) end')} as {x}"
_RAW = "count(*) as n, avg(hit) as coverage, avg(cast(size = 0 as integer)) as empty_rate, avg(cast(size = 1 as integer)) as singleton_rate, avg(cast(size = 2 as integer)) as ambiguity_rate, avg(size) as avg_set_size, count(*) filter (target = 0) as n_y0, avg(hit) filter (target = 0) as coverage_y0, count(*) filter (target = 1) as n_y1, avg(hit) filter (target = 1) as coverage_y1"


@query(
    f"""with {_BLOCKED}, {_PAIRS}, q as (select wk, quantile_cont({_SYM}, {_A}) q from cal group by 1), x as (select *, y_prob <= q as i0, 1e0 - y_prob <= q as i1 from blocks join q on wk = block), y as (select *, {_SETS} from x), w as (select block, {_RAW} from y group by 1)
 select count(*) as weeks, cast(sum(n) as bigint) as n_total, {', '.join(_MEAN(x, 'n') for x in ('coverage', 'empty_rate', 'singleton_rate', 'ambiguity_rate', 'avg_set_size'))}, {_MEAN('coverage_y0', 'n_y0')}, {_MEAN('coverage_y1', 'n_y1')} from w"""
)
def conformal_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(conformal.summarize_weeks(conformal.rolling_symmetric(_rolling(spark, d)[0], _FIRST, week="block")))


_NUMBERS = ["quantity_1P", "extprice_2A", "discount_3P", "tax_4P"]
_SQLNUM = dict(zip(_NUMBERS, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {R(f'corr({_SQLNUM[a]}, {_SQLNUM[b]})')} as corr from lineitem" for j, b in enumerate(_NUMBERS) for a in _NUMBERS[:j]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(select.correlation_matrix(lines(spark, d), _NUMBERS))


_AGGS = [f"{n}_{c}" for c in _NUMBERS for n in ("mean", "max", "last")]
_ORDERED = "row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"
_AGG_SQL = ", ".join(f"{f} as \"{n}_{c}\"" for c, x in _SQLNUM.items() for n, f in (("mean", f"avg({x})"), ("max", f"max({x})"), ("last", f"arg_max_null({x}, {_ORDERED})")))
_PREFER = lambda c: "case split_part({0}, '_', 1) when 'mean' then 1 when 'max' then 2 else 4 end".format(c)


@query(
    f"""with recursive x as (select l_orderkey, {_AGG_SQL} from lineitem group by 1), pairs as ({' union all '.join(f"select {j * 100 + i} as k, {i} as i, '{a}' as a, '{b}' as b, abs(corr(\"{a}\", \"{b}\")) > 0.8 as strong from x" for j, b in enumerate(_AGGS) for i, a in enumerate(_AGGS[:j]))}),
 line as (select *, row_number() over (order by k) as pos from pairs),
 st(pos, gone, off) as (select cast(0 as bigint), cast([] as varchar[]), false union all
  select st.pos + 1, case when strong and not (case when i = 0 then list_contains(gone, b) else off end) and not list_contains(gone, a) then list_append(gone, case when {_PREFER('a')} > {_PREFER('b')} then a else b end) else gone end, case when i = 0 then list_contains(gone, b) else off end
  from st join line on line.pos = st.pos + 1)
 select f as feature, list_contains((select gone from st order by pos desc limit 1), f) as dropped from (select unnest({_AGGS}) as f)"""
)
def corr_filter(spark: SparkSession, d: str) -> DataFrame:
    last = lambda c: F.max_by(c, F.struct(*[F.col(o) for o in LINE_ORDER]))
    x = lines(spark, d).groupBy("case_id").agg(*[f(c).alias(f"{n}_{c}") for c in _NUMBERS for n, f in (("mean", F.avg), ("max", F.max), ("last", last))])
    kept, gone = select.correlation_filter(x, [c for c in x.columns if c != "case_id"])
    return spark.createDataFrame([(c, c in gone) for c in kept + gone], "feature string, dropped boolean")


_GAIN = "select o_orderpriority as feature, sum(o_totalprice) as gain from orders group by 1 union all select o_orderstatus, sum(o_totalprice) / 40 from orders group by 1"


@query(
    f"with x as ({_GAIN}) select feature, {R('gain / 1e6')} as gain, row_number() over (order by gain desc, feature) as rank, {R('gain / sum(gain) over () * 100')} as gain_pct, {R('sum(gain) over (order by gain desc, feature) / sum(gain) over () * 100')} as cum_pct from x"
)
def importance_cumshare(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("__orders")
    c = select.importance_curve(spark.sql(_GAIN.replace("from orders", "from __orders")))
    return tidy(c.withColumn("gain", F.col("gain") / 1e6))


@query(
    f"with x as ({_GAIN}), c as (select row_number() over (order by gain desc, feature) r, gain / sum(gain) over () * 100 s, sum(gain) over (order by gain desc, feature) / sum(gain) over () * 100 u from x) select min(r) filter (s < 1) - 1 as elbow, min(r) filter (u >= 95) as k95, min(r) filter (u >= 90) as k90 from c"
)
def importance_points(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("__orders")
    return tidy(select.curve_points(select.importance_curve(spark.sql(_GAIN.replace("from orders", "from __orders")))))


@query(
    f"""with x as ({_GAIN}), c as (select cast(row_number() over (order by gain desc, feature) as double) r, gain / sum(gain) over () * 100 s from x),
 n as (select *, (r - min(r) over ()) / (max(r) over () - min(r) over ()) as xs, (max(s) over () - s) / (max(s) over () - min(s) over ()) as ys, count(*) over () as n from c),
 d as (select *, ys - xs as d, lag(ys - xs) over (order by r) as before, lead(ys - xs) over (order by r) as after from n),
 m as (select r, d - 1e0 / (n - 1) as bar, coalesce(lead(r) over (order by r), 1e9) as until from d where d > before and d >= after),
 k as (select m.r from m where exists (select 1 from d where d.r > m.r and d.r < m.until and d.d < m.bar)) select min(r) as knee from k"""
)
def importance_knee(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("__orders")
    rows = select.importance_curve(spark.sql(_GAIN.replace("from orders", "from __orders"))).orderBy("rank").collect()
    k = select.knee([float(r["rank"]) for r in rows], [r.gain_pct for r in rows])
    return spark.createDataFrame([(k,)], "knee double")


@query("select feature from ((select o_clerk as feature from (select c_name as o_clerk from customer order by c_acctbal desc, c_name limit 276)) union (select c_name from (select c_name from customer order by c_nationkey desc, c_name limit 201)))")
def topk_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return select.union_of_tops(c.select(F.col("c_name").alias("feature"), F.col("c_acctbal").alias("gain")), c.select(F.col("c_name").alias("feature"), F.col("c_nationkey").alias("shap")))


@query(
    " union all ".join(
        f"select '{c}' as feature, count({x}) as n, {R(f'avg(cast({x} is null as integer))')} as na_rate, count(distinct {x}) as levels, {R(f'min({x})')} as min, {R(f'median({x})')} as median, {R(f'max({x})')} as max from lineitem" for c, x in _SQLNUM.items()
    )
)
def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    return tidy(select.feature_profile(lines(spark, d), _NUMBERS))


@query("select l_partkey as value, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 10")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return select.top_values(lines(spark, d), "l_partkey")


def _features(spark: SparkSession, d: str) -> DataFrame:
    child = lines(spark, d).groupBy("case_id").agg(F.avg("quantity_1P").alias("quantity"), F.max("extprice_2A").alias("extprice"), F.count("*").alias("lines"))
    x = cases(spark, d).join(child, "case_id", "left")
    noise = F.pmod(F.xxhash64("case_id"), F.lit(1000)) / 1000.0
    return x.select("case_id", "WEEK_NUM", "target", F.col("price_1A").alias("price"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("extprice", F.lit(0.0)).alias("extprice"), F.coalesce("lines", F.lit(0)).cast("double").alias("lines"), (F.col("target") * 0.4 + noise).alias("signal"))


_X = ["price", "quantity", "extprice", "lines", "signal"]


_Z = "ln(least(greatest(y_prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(y_prob, 1e-6), 1 - 1e-6)))"


@query(
    f"""with recursive {CASES}, v as (select {_Z} as z, cast(target as double) as t from val),
 it(k, a, b) as (select 0, 0e0, 0e0 union all select k + 1, a - (sbb * ga - sab * gb) / (saa * sbb - sab * sab), b - (saa * gb - sab * ga) / (saa * sbb - sab * sab)
  from (select k, a, b, sum((q - t) * z) + a as ga, sum(q - t) as gb, sum(q * (1 - q) * z * z) + 1 as saa, sum(q * (1 - q) * z) as sab, sum(q * (1 - q)) as sbb from (select k, a, b, z, t, 1 / (1 + exp(-(a * z + b))) as q from it, v where k < 12) group by k, a, b)),
 f as (select a, b from it where k = 12) select case_id, cast(target as bigint) as target, {R('y_prob')} as y_prob, {R(f'1 / (1 + exp(-({_Z} * a + b)))')} as y_prob_cal from test, f"""
)
def platt_calibrate(spark: SparkSession, d: str) -> DataFrame:
    _, val, test = splits(spark, d)
    return tidy(calibrate.Platt.fit(val).transform(test).select("case_id", "target", "y_prob", "y_prob_cal"))


#: The isotonic value of a point is the greatest, over starts at or before it, of the least mean up to an end at or after it.
@query(
    f"""with {CASES}, g as (select y_prob x, count(*)::double w, sum(target)::double s from val group by 1), c as (select x, row_number() over (order by x) i, w, s, sum(w) over (order by x) cw, sum(s) over (order by x) cs from g),
 m as (select a.i as a, b.i as b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as v from c a join c b on b.i >= a.i), l as (select a, b, min(v) over (partition by a order by b desc) as v from m),
 f as (select i, x, (select max(v) from l where l.b = c.i) as y from c), s as (select x, y, lead(x, 1, x) over (order by x) as x2, lead(y, 1, y) over (order by x) as y2 from f),
 lim as (select min(x) as lo, max(x) as hi, arg_min(y, x) as ylo, arg_max(y, x) as yhi from f)
 select case_id, cast(target as bigint) as target, {R('t.y_prob')} as y_prob, {R('case when t.y_prob <= lo then ylo when t.y_prob >= hi then yhi when x2 = x then y else y + (y2 - y) * (t.y_prob - x) / (x2 - x) end')} as y_prob_cal
 from test t asof left join s on t.y_prob >= s.x, lim"""
)
def isotonic_calibrate(spark: SparkSession, d: str) -> DataFrame:
    _, val, test = splits(spark, d)
    return tidy(calibrate.Isotonic.fit(val).transform(test).select("case_id", "target", "y_prob", "y_prob_cal"))


def _boosted(spark: SparkSession, d: str) -> tuple[model.Boosted, DataFrame]:
    x = _features(spark, d)
    return model.Boosted.fit(x.where(F.col("WEEK_NUM") <= WEEKS.train_end), _X, rounds=5, depth=3), x


@query()
def gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    m, x = _boosted(spark, d)
    return m.predict(x.where(F.col("WEEK_NUM") > WEEKS.train_end))


@query()
def gain_importance(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d)[0].gain(spark)


@query()
def shap_importance(spark: SparkSession, d: str) -> DataFrame:
    m, x = _boosted(spark, d)
    return model.mean_abs(m.contributions(x), _X)


@query()
def shap_weekly(spark: SparkSession, d: str) -> DataFrame:
    m, x = _boosted(spark, d)
    return model.mean_abs(m.contributions(x), _X, ["WEEK_NUM"])


@query()
def shap_dependence(spark: SparkSession, d: str) -> DataFrame:
    m, x = _boosted(spark, d)
    s = m.contributions(x).select("case_id", F.col("signal").alias("s")).join(x.select("case_id", "WEEK_NUM", "signal"), "case_id")
    return model.dependence(s.where(F.col("WEEK_NUM").between(258, 279)), s.where("WEEK_NUM >= 280"), "signal", "s", least=5)


@query()
def hyper_search(spark: SparkSession, d: str) -> DataFrame:
    from riskspark.operators.prepare import expanding_folds

    best, score, rounds = model.search(_features(spark, d), _X, expanding_folds(0, WEEKS.train_end, folds=2, span=20), trials=2, rounds=3)
    return spark.createDataFrame([(str(sorted(best.items())), score, rounds, model.final_rounds(rounds))], "params string, mean_ap double, best_rounds long, final_rounds long")


@query()
def gain_shap_selector(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d)
    return model.GainShapSelector.fit(x.where(F.col("WEEK_NUM") <= WEEKS.train_end), _X, 2, 2, rounds=3).transform(x)


@query()
def density_ratio_weights(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d)
    return model.weight_summary(model.domain_weights(x.where("WEEK_NUM between 258 and 279"), x.where("WEEK_NUM >= 280"), ["price", "quantity", "lines"]))


@query(
    f"with {_BLOCKED}, g as (select case_id, (1 + case_id % 9) / 10e0 as g from cases), r as (select case_id, g / (1 - g) * 100 / 50 as w from g), c as (select quantile_cont(w, 0.99) c from r) select case_id, {R('least(w, c)')} as w from r, c"
)
def density_ratio_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", ((1 + F.col("case_id") % 9) / F.lit(10.0)).alias("g"))
    return tidy(conformal.density_ratio(x, "g", 100, 50).select("case_id", "w"))


@query("select cast(time_bucket(interval '7 days', cast(ts as timestamp), timestamp '1970-01-01') as timestamp) as start, event_type, count(*) as n, " + R("sum(value)") + " as total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from riskspark.streaming.monitor import windowed_counts

    x = windowed_counts(table(spark, d, "events"))
    return tidy(x.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"with {CASES} select case_id, week_num as \"WEEK_NUM\", cast(target as bigint) as target, {R('least(greatest(y_prob, 0.1e0), 0.9e0)')} as y_prob from cases where case_id % 5 <> 0")
def valid_predictions(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).select("case_id", "WEEK_NUM", F.col("target").cast("string").alias("target"), F.when(F.col("case_id") % 5 == 0, "bad").otherwise(clip(F.col("y_prob"), 0.1, 0.9).cast("string")).alias("y_prob"))
    return tidy(metrics.valid_predictions(x, ["case_id", "WEEK_NUM"]))


def _weighted_q(source: str, keys: str, by: str) -> str:
    """CTE `wq`: by keys and class, the least score at which the running weight reaches its share."""
    return f"""ws as (select {keys}, target as y, {_LL} as s, sum(w) as w from {source} group by all), wc as (select {keys}, y, s, sum(w) over (partition by {keys}, y order by s) cw, sum(w) over (partition by {keys}, y) tw from ws),
 wq as (select {keys}, min(s) filter (y = 0 and cw >= {_A} * tw) a0, min(s) filter (y = 1 and cw >= {_A} * tw) a1 from wc group by all)"""


_WPAIRS = f"tg as (select distinct block as wk from blocks where block >= {_FIRST}), cal as (select wk, target, y_prob, {_WEIGHT} as w from blocks, tg where block between wk - 6 and wk - 1)"


@query(
    f"""with {_BLOCKED}, {_WPAIRS}, {_GLOBAL}, {_weighted_q('cal', 'wk', 'wk')}, q as (select wk, count(*) filter (target = 0) n0, count(*) filter (target = 1) n1 from cal group by 1),
 p as (select q.wk, case when n0 < 20 then g0 else a0 end q0, case when n1 < 20 then g1 else a1 end q1, cast(n0 < 20 as integer) f0, cast(n1 < 20 as integer) f1 from q join wq on wq.wk = q.wk, gl),
 x as (select *, {_LL0} <= q0 as i0, {_LL1} <= q1 as i1 from blocks join p on wk = block), y as (select *, {_SETS} from x)
 select block, {R('max(q0)')} as q0, {R('max(q1)')} as q1, cast(max(f0) as bigint) as fallback_q0, cast(max(f1) as bigint) as fallback_q1, {_COVER} from y group by 1"""
)
def conformal_mondrian_weighted(spark: SparkSession, d: str) -> DataFrame:
    x, val = _rolling(spark, d)
    return tidy(conformal.rolling_mondrian(x.withColumn("w", 1 + F.col("case_id") % 7), val, _FIRST, weight="w", week="block"))


@query(
    f"""with {_BLOCKED}, {_WPAIRS}, {_GLOBAL}, ed as (select wk, quantile_cont(y_prob, {_qs(5)}) e from cal group by 1), cb as (select cal.wk, target, y_prob, w, len(list_filter(e, lambda t: t < y_prob)) bin from cal join ed on ed.wk = cal.wk), {_weighted_q('cb', 'wk, bin', 'wk')},
 q as (select wk, bin, count(*) n, count(*) filter (target = 0) n0, count(*) filter (target = 1) n1 from cb group by 1, 2), s as (select wk, unnest(range(0, 5)) bin from ed),
 f as (select s.wk, s.bin, coalesce(n, 0) < 200 thin, n0 < 20 t0, n1 < 20 t1, a0, a1, g0, g1 from s left join q on q.wk = s.wk and q.bin = s.bin left join wq on wq.wk = s.wk and wq.bin = s.bin, gl),
 p as (select wk, bin, thin, not thin and t0 as f0, not thin and t1 as f1, case when thin or t0 then g0 else a0 end q0, case when thin or t1 then g1 else a1 end q1 from f),
 fr as (select wk, avg(cast(thin as integer)) fb, avg(cast(f0 as integer)) r0, avg(cast(f1 as integer)) r1 from p group by 1),
 tb as (select blocks.*, wk, len(list_filter(e, lambda t: t < y_prob)) bin from blocks join ed on wk = block), x as (select tb.*, {_LL0} <= q0 as i0, {_LL1} <= q1 as i1 from tb join p on p.wk = tb.wk and p.bin = tb.bin), y as (select *, {_SETS} from x)
 select block, {_COVER}, {R('max(fb)')} as fallback_bin_rate, {R('max(r0)')} as fallback0_rate, {R('max(r1)')} as fallback1_rate from y join fr on fr.wk = block group by 1"""
)
def conformal_binned_weighted(spark: SparkSession, d: str) -> DataFrame:
    x, val = _rolling(spark, d)
    return tidy(conformal.rolling_binned(x.withColumn("w", 1 + F.col("case_id") % 7), val, _FIRST, weight="w", week="block"))


@query(
    f"""with {CASES} select {R('coalesce(quantile_cont(' + _LL + ', ' + _A + ") filter (target = 0), 'inf'::double)")} as q0_global, {R('coalesce(quantile_cont(' + _LL + ', ' + _A + ") filter (target = 1), 'inf'::double)")} as q1_global from val"""
)
def conformal_global(spark: SparkSession, d: str) -> DataFrame:
    return tidy(conformal.global_thresholds(splits(spark, d)[1]))


@query("select c_custkey as id, c_acctbal, o_orderkey from customer join (select o_custkey, o_orderkey from orders) on o_custkey = c_custkey")
def discovered_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return join.merge_on_id(a, table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey"))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as case_id from orders")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return join.number_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("case_id").cast("bigint").alias("case_id"))


@query("select level, cast(dense_rank() over (order by level) - 1 as integer) as code from (select l_returnflag as level from lineitem union select o_orderstatus from orders)")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"))
    return model.category_codes(a, table(spark, d, "orders").select(F.col("o_orderstatus").alias("x")), "x")


def _qcut_iv(x: str) -> str:
    return f"""(with r as (select target, row_number() over (order by {x}, case_id) as r, count(*) over () as n from train), b as (select target, len(list_filter([1 + (n - 1) * (i / 10e0) for i in range(1, 10)], lambda t: t < r)) as bin from r),
 c as (select bin, sum(target) bad, sum(1 - target) good from b group by 1), p as (select bad / sum(bad) over ()::double b, good / sum(good) over ()::double g from c) select sum((b - g) * ln((b + 1e-6) / (g + 1e-6))) from p)"""


_LEVEL_IV = "(with c as (select weekday_decision, sum(target) bad, sum(1 - target) good from train group by 1), p as (select bad / sum(bad) over ()::double b, good / sum(good) over ()::double g from c) select sum((b - g) * ln((b + 1e-6) / (g + 1e-6))) from p)"


@query(f"with {CASES}, v as (select 'price_1A' as feature, {_qcut_iv('price_1a')} as iv union all select 'y_prob', {_qcut_iv('y_prob')} union all select 'weekday_decision', {_LEVEL_IV}) select feature, {R('iv')} as iv from v where iv >= 0.005")
def iv_filter(spark: SparkSession, d: str) -> DataFrame:
    found = drift.iv_filter(splits(spark, d)[0], ["price_1A", "y_prob", "weekday_decision"], ["case_id"])
    return tidy(spark.createDataFrame(sorted(found.items()), "feature string, iv double"))
