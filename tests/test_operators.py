import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import bins, rules, schema
from riskspark.functions.numeric import clip
from riskspark.operators import business, conformal, drift, metrics, model, prepare, select, tables
from riskspark.sources import files
from riskspark.streaming import monitor


def scores(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, i // 40, int(r.random() < 0.3), round(r.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, WEEK_NUM long, target int, y_prob double"), rows


def test_suffix_types_leave_reserved_names(spark):
    df = spark.createDataFrame([("1", "7", "2.5", "3", "2024-01-02")], "case_id string, WEEK_NUM string, a_1P string, b_2M string, c_3D string")
    assert dict(schema.cast_by_suffix(df).dtypes) == {"case_id": "bigint", "WEEK_NUM": "bigint", "a_1P": "double", "b_2M": "string", "c_3D": "date"}
    bad = spark.createDataFrame([("x",)], "a_1P string")
    assert schema.cast_by_suffix(bad, strict=False).first()[0] is None
    with pytest.raises(Exception):
        schema.cast_by_suffix(bad).collect()


def test_fill_and_impute(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "x_1A double, zip_2M int, c_3M string, t_4L string, d_delta double")
    assert tables.fill_by_suffix(df).first().asDict() == {"x_1A": 0.0, "zip_2M": -1, "c_3M": "missing", "t_4L": None, "d_delta": None}
    assert tables.soft_impute(df).first().asDict() == {"x_1A": 0.0, "zip_2M": -1, "c_3M": "missing", "t_4L": "UNKNOWN", "d_delta": None}


def test_rules_skip_what_is_not_there(spark):
    df = spark.createDataFrame([(10.0, 0.0)], "currdebt_22A double, maininc_215A double")
    out = rules.add_combos(df)
    assert set(out.columns) - set(df.columns) == {"dti_ratio", "dti_high_flag"}
    assert out.first().dti_ratio == pytest.approx(10000)
    made = rules.add_combos(df, {"a": lambda: F.lit(1), "b": F.lit(2), "currdebt_22A": "1"}).first()
    assert (made.a, made.b, made.currdebt_22A) == (1, 2, 10.0)
    with pytest.raises(TypeError):
        rules.combo_columns(df, {"a": lambda: 3})
    with pytest.raises(ValueError):
        rules.add_case_combos(df)


def test_last_keeps_nulls_and_orders(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, 3.0)], "case_id long, num_group1 long, x_1P double")
    got = {r.case_id: (r.last_x_1P, r.max_x_1P) for r in tables.aggregate_child(df, ["num_group1"]).collect()}
    assert got == {1: (None, 5.0), 2: (3.0, 3.0)}


def test_coalescing_join_prefers_the_left(spark):
    a = spark.createDataFrame([(1, None), (2, 7)], "case_id long, v int")
    b = spark.createDataFrame([(1, 5, 1), (2, 6, 2)], "case_id long, v int, w int")
    assert sorted(map(tuple, tables.coalescing_join(a, [b]).collect())) == [(1, 5, 1), (2, 7, 2)]


def test_bins_on_tied_edges(spark):
    e = [1.0, 1.0, 2.0]
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 3.0)], "x double")
    got = df.select(bins.left_closed(F.col("x"), e).alias("l"), bins.right_closed(F.col("x"), e).alias("r")).collect()
    assert [r.l for r in got] == list(np.digitize([0.5, 1, 1.5, 2, 3], e))
    assert [r.r for r in got] == list(np.digitize([0.5, 1, 1.5, 2, 3], e, right=True))
    p = [0.0, 0.05, 0.15, 0.150000001, 0.3, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(bins.score_bin(F.col("p"))).collect()]
    assert got == [max(1, int(b)) for b in np.digitize(p, np.linspace(0, 1, 21), right=True)]


def test_ranking_metrics_by_hand(spark):
    df, rows = scores(spark)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    ap = sum(((y == 1) & (p == s)).sum() / (y == 1).sum() * ((y == 1) & (p >= s)).sum() / (p >= s).sum() for s in set(p))
    ks = max(abs(((y == 1) & (p >= s)).sum() / (y == 1).sum() - ((y == 0) & (p >= s)).sum() / (y == 0).sum()) for s in set(p))
    r = metrics.ranking_metrics(df).first()
    assert (r.roc_auc, r.pr_auc, r.ks) == (pytest.approx(np.mean(pairs)), pytest.approx(ap), pytest.approx(ks))
    one = metrics.ranking_metrics(df.where("target = 1"), ["WEEK_NUM"]).collect()
    assert all(r.roc_auc is None for r in one)


def test_psi_properties(spark):
    df, _ = scores(spark)
    assert drift.psi(df, df, "y_prob").first().psi == pytest.approx(0)
    few = drift.weekly_psi(df, df, bins=10, least=41).collect()
    assert all(r.psi is None for r in few) and len(few) == 10
    b = drift.psi_bins(df, df.where("y_prob > 0.9"), "y_prob").collect()
    assert len(b) == 10 and sum(r.act_rate for r in b) == pytest.approx(1)


def test_ks_two_sample(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 9.0]
    got = drift.ks_two_sample(spark.createDataFrame([(x,) for x in a], "v double"), spark.createDataFrame([(x,) for x in b], "v double"), "v").first().ks
    assert got == pytest.approx(max(abs(np.mean(np.array(a) <= t) - np.mean(np.array(b) <= t)) for t in a + b))


def test_small_bins_merge_in_turn():
    assert drift.merge_small_bins([(0, 50), (1, 5), (2, 5), ("MISSING", 3)], 30) == {0: 0, 1: 0, 2: 1, "MISSING": 0}
    assert drift.merge_small_bins([(0, 5)], 30) == {0: 0}


def test_thresholds_and_curves(spark):
    df, rows = scores(spark)
    c = business.threshold_curve(df).orderBy("threshold").collect()
    assert len(c) == 201 and c[-1].n_approved == 400 and all(a.n_approved <= b.n_approved for a, b in zip(c, c[1:]))
    assert c[100].n_approved == sum(r[3] <= 0.5 for r in rows)
    assert business.lift_curve(df).orderBy("bin_idx").collect()[-1].lift == pytest.approx(1)
    assert business.threshold_under_cap(df, (0.0,)).count() in (0, 1)
    assert business.threshold_under_cap(df, (1.0,)).first().approve_rate == 1.0
    assert business.strategy_table(df.where("target = 1"), df, (0.1,)).count() == 0


def test_weighted_quantile(spark):
    v, w = [3.0, 1.0, 2.0, 2.0], [1, 5, 2, 2]
    df = spark.createDataFrame(list(zip(v, w)), "v double, w int")
    assert [conformal.weighted_quantile(df, "v", "w", q).first().q for q in (0.1, 0.5, 0.51, 0.9, 1.0)] == [1.0, 1.0, 2.0, 2.0, 3.0]


def test_split_conformal_covers(spark):
    df, _ = scores(spark, 2000)
    r = conformal.split_conformal(df.where("case_id < 1000"), df.where("case_id >= 1000")).first()
    assert r.test_coverage > 0.92


def test_running_encoding_is_sequential(spark):
    r = random.Random(3)
    rows = [(i, i // 30, r.choice("ab"), None if r.random() < 0.2 else int(r.random() < 0.4)) for i in range(500)]
    df = spark.createDataFrame(rows, "case_id long, WEEK_NUM long, c string, target int")
    got = {x.case_id: (x.c_te, x.c_trend) for x in prepare.running_target_encode(df, None, "c", ["WEEK_NUM", "case_id"], prior=0.4, own=True).collect()}
    state: dict = {}
    for i, _, c, y in rows:
        s = state.setdefault(c, [])
        mean, trend = 0.4, 0.0
        if len(s) >= 50:
            w = 100 / (len(s) + 10)
            a, b = (sum(s) + y, len(s) + 1) if y is not None else (sum(s), len(s))
            mean = (a + 0.4 * w) / (b + w)
            trend = sum(s[-100:]) / min(100, len(s)) - mean
        assert got[i] == (pytest.approx(mean), pytest.approx(trend))
        if y is not None:
            s.append(y)


def test_one_hot_levels_are_frozen(spark):
    a = spark.createDataFrame([(1, "x"), (0, "y"), (1, "z")], "target int, c string")
    e = prepare.Encoder.fit(a)
    out = e.one_hot(spark.createDataFrame([(1, "z"), (0, "new"), (0, None)], "target int, c string"))
    assert out.columns == ["target", "c_y", "c_z"] and [tuple(r)[1:] for r in out.collect()] == [(0, 1), (0, 0), (0, 0)]


def test_pruner(spark):
    df = spark.createDataFrame([(float(i), 1, None, float(i) - 5, i % 2) for i in range(100)], "x_A double, k_A int, n_P double, r_ratio double, f_P int")
    p = prepare.Pruner.fit(df)
    assert set(p.drop) == {"k_A", "n_P"} and set(p.high) == {"x_A", "r_ratio"}
    assert p.transform(df).agg(F.min("r_ratio"), F.max("x_A")).first() == (0.0, pytest.approx(np.quantile(np.arange(100), 0.998)))


def test_correlation_filter_prefers_means(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2, float(-i), float(i * i % 7)) for i in range(50)], "max_a double, mean_a double, last_a double, b double")
    assert select.correlation_filter(df, df.columns)[1] == ["last_a", "max_a"]


def test_knee():
    assert select.knee([1, 2], [2, 1]) is None
    y = [1 / x for x in range(1, 30)]
    assert 3 <= select.knee(list(map(float, range(1, 30))), y) <= 7


def test_contributions_add_up(spark):
    r = random.Random(5)
    rows = [(i, r.random(), r.random(), r.random()) for i in range(300)]
    df = spark.createDataFrame([(i, int(a + b * c > 0.7), a, b, c) for i, a, b, c in rows], "case_id long, target int, a double, b double, c double")
    m = model.Boosted.fit(df, ["a", "b", "c"], rounds=3, depth=3)
    base = sum(v * math.prod(s for *_, s in path) for v, path in m.leaves())
    phi = {x.case_id: x.a + x.b + x.c for x in m.contributions(df, ["case_id"]).collect()}
    raw = {x.case_id: x.rawPrediction[1] for x in m.model.transform(model._vectors(df, m.features)).collect()}
    assert all(phi[i] + base == pytest.approx(raw[i], abs=1e-9) for i in phi)


def test_folds_and_rounds():
    assert prepare.expanding_folds(0, 69) == [(0, 54, 57), (0, 58, 61), (0, 62, 65), (0, 66, 69)]
    assert (model.final_rounds(10), model.final_rounds(1000), model.final_rounds(9000)) == (100, 1100, 6000)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, "1", "1.7"), (2, 3, "0", "x"), (3, 4, "1", "0.25")], files.PREDICTIONS)
    files.write_csv(df, f"{tmp_path}/p")
    assert files.read_predictions(spark, f"{tmp_path}/p").count() == 2
    assert {r.y_prob for r in files.read_predictions(spark, f"{tmp_path}/p", strict=False).collect()} == {1.0, 0.25}
    with pytest.raises(ValueError):
        metrics.valid_predictions(df.drop("y_prob"))
    files.write_parquet(df.select("case_id", "WEEK_NUM"), f"{tmp_path}/t", dictionary=False)
    assert files.read_tables(spark, f"{tmp_path}/t").count() == 3
    calls = []
    make = lambda: calls.append(1) or ["b", "a"]
    assert files.cached_lines(spark, f"{tmp_path}/l", make) == files.cached_lines(spark, f"{tmp_path}/l", make) and len(calls) == 1
    files.write_csv(spark.createDataFrame([(1 / 3,)], "x double"), f"{tmp_path}/g", significant=7)
    assert spark.read.option("header", True).csv(f"{tmp_path}/g").first()[0] == "0.3333333"


def test_clip_keeps_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (2.0,)], "x double").select(clip(F.col("x"), 0, 1)).collect()] == [None, 1.0]


def test_streamed_windows_equal_batch(spark, tmp_path):
    src = f"{tmp_path}/events"
    spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-09 10:00:00", "a", 2.0), ("2024-01-09 11:00:00", "b", 3.0)], "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").write.parquet(src)
    schema_ = spark.read.parquet(src).schema
    q = monitor.windowed_counts(spark.readStream.schema(schema_).parquet(src)).writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, monitor.windowed_counts(spark.read.parquet(src)).collect()))


@pytest.mark.parametrize("error", [None, 0.004])
def test_quantiles_are_exact(spark, monkeypatch, error):
    from riskspark.operators import ranks

    if error:  # as coarse as the sketch of very many rows is beside them
        monkeypatch.setattr(ranks, "ERROR", error)
    r = np.random.default_rng(3)
    groups = {"many": np.round(r.normal(size=3000) ** 3, 3), "spike": np.where(r.random(900) < 0.4, 7.0, r.random(900) * 10), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("few", None), ("one", float("nan"))]
    probs = [0.0, 0.01, 0.333, 0.5, 0.95, 0.998, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x.q for x in ranks.quantiles(df, "v", probs, ["k"]).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)
    assert ranks.quantiles(df, "v", [0.5]).first().q[0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert ranks.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_ranks_with_a_spike(spark):
    from riskspark.operators import ranks

    r = random.Random(5)
    rows = [(i, 0.5 if r.random() < 0.6 else round(r.random(), 3)) for i in range(2000)] + [(5000, 1e12)]
    df = spark.createDataFrame(rows, "i long, v double")
    for down in (False, True):
        want = sorted(rows, key=lambda x: (-x[1] if down else x[1], x[0]))
        got = {x.i: x["rank"] for x in ranks.ranked(df, ["v", "i"], descending=down).collect()}
        assert got == {i: n for n, (i, _) in enumerate(want, 1)}
    assert ranks.sliced(df, ["v", "i"]).groupBy("__slice").count().agg({"count": "max"}).first()[0] < 200


def test_correlations_of_many_columns(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5)) @ r.normal(size=(5, 5)) + 1e4
    rows = [tuple(None if r.random() < 0.1 else float(v) for v in t) + (1.0,) for t in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    few = {(t.a, t.b): t.corr for t in select.correlation_matrix(df, df.columns).collect()}
    monkeypatch.setattr(select, "FEW", 2)
    many = {(t.a, t.b): t.corr for t in select.correlation_matrix(df, df.columns).collect()}
    assert few.keys() == many.keys() and all(many[p] == (pytest.approx(few[p], abs=1e-9) if "f" not in p else None) for p in few)


def test_encoding_from_a_kept_state(spark):
    r = random.Random(2)
    rows = [(i, i // 60, r.choice("abc") if i % 50 else None, None if r.random() < 0.1 else int(r.random() < 0.3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "case_id long, WEEK_NUM long, k string, target int")
    order = ["WEEK_NUM", "case_id"]
    old, new = df.where("WEEK_NUM < 18"), df.where("WEEK_NUM >= 18")
    a = prepare.running_target_encode(new, old, "k", order, prior=0.3)
    b = prepare.running_target_encode(new, None, "k", order, prior=0.3, state=prepare.encoder_state(old, "k", order))
    got, want = ({x.case_id: (x.k_te, x.k_trend) for x in t.collect()} for t in (b, a))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    seen: dict = {}
    for i, w, k, y in rows:
        h = seen.setdefault(k, [])
        if w >= 18:
            te = (sum(h) + 0.3 * 100 / (len(h) + 10)) / (len(h) + 100 / (len(h) + 10)) if len(h) >= 50 else 0.3
            assert want[i] == pytest.approx((te, np.mean(h[-100:]) - te if len(h) >= 50 else 0.0))
        if y is not None:
            h.append(y)


def test_excel(spark, tmp_path):
    import xml.etree.ElementTree as ET
    import zipfile

    path = str(tmp_path / "report.xlsx")
    files.write_excel(spark.createDataFrame([("a & <b>", 1, 2.5), (None, 2, float("nan"))], "name string, n int, x double"), path)
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            ET.fromstring(z.read(n))
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
    cells = [["".join(c.itertext()) for c in r] for r in sheet.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")]
    assert cells == [["name", "n", "x"], ["a & <b>", "1", "2.5"], ["", "2", ""]]
    with pytest.raises(ValueError):
        files.write_excel(spark.range(5), path, most=3)


def test_trials_lean_on_good_ones():
    draw, tried = random.Random(0), []
    for _ in range(150):
        p = model.propose(tried, draw)
        tried.append((p, -abs(p["depth"] - 5) - 10 * abs(p["rate"] - 0.05)))
    late = [p for p, _ in tried[100:]]
    assert sum(p["depth"] == 5 and p["rate"] == 0.05 for p in late) > 25
    assert model.propose([], draw).keys() == model.SPACE.keys()


def test_contributions_add_up(spark):
    r = random.Random(6)
    rows = [(i, 0, int(r.random() < 0.3 + 0.4 * (i % 3 == 0)), float(i % 3), r.random(), float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "case_id long, WEEK_NUM long, target int, a double, b double, c double")
    m = model.Boosted.fit(df, ["a", "b", "c"], rounds=3, depth=5)
    phi = {x.case_id: x.a + x.b + x.c for x in m.contributions(df).collect()}
    margin = {x.case_id: math.log(x.y_prob / (1 - x.y_prob)) / 2 for x in m.predict(df).collect()}
    gaps = [margin[i] - phi[i] for i in phi]
    assert max(gaps) - min(gaps) < 1e-9  # what is left is the mean margin, the same for all


def test_weekly_domain_weights(spark):
    r = random.Random(1)
    rows = [(i, i // 100, r.gauss((i // 100) * 0.3, 1.0)) for i in range(800)]
    df = spark.createDataFrame(rows, "case_id long, WEEK_NUM long, x double")
    w = model.weekly_domain_weights(df, ["x"], 6, window=3)
    found = w.groupBy("wk").agg(F.count("*").alias("n"), F.corr("x", "w").alias("c")).collect()
    assert {x.wk: x.n for x in found} == {6: 300, 7: 300} and all(x.c > 0.5 for x in found)


def test_unknown_types_raise(spark):
    with pytest.raises(ValueError):
        schema.normalise(spark.sql("select current_timestamp() as t"))
    with pytest.raises(ValueError):
        from riskspark.operators import join

        join.positional_join(spark.range(3), spark.range(4).toDF("b"), ["id"], ["b"])
