import numpy as np

from riskspark.llm import embed_dedup, graph_ann

VECTORS = "vec_id long, embedding array<float>"


def table(spark, seed=0, n=900, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, 300, 3):  # near ones, some just over and some just under the limit
        x[i + 1] = x[i] + rng.normal(size=dim) * rng.choice([0.02, 0.25, 0.31, 0.36])
    x[400:460] = x[400]
    x[500:560] = x[500] * 3 + rng.normal(size=(60, dim)) * 0.05
    x = x.astype(np.float32)
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0, None] * (dim // 2)), (n + 4, [float("inf")] * dim), (n + 5, []), (n + 6, [1.0] * 3), (None, [1.0] * dim)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + odd
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as label", "2 as v", "3 as n", "4 as dim"), x.astype(float), n


def test_links_and_components(spark):
    df, x, n = table(spark)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    links = np.array([got[i].n_links for i in range(n)])
    assert (links <= s.sum(1)).all() and links.sum() >= 0.97 * s.sum()  # none below the limit
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in range(n))
    assert all(got[400 + i].component_id == got[400].component_id for i in range(60))
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    df, x, n = table(spark, 1, 600)
    small = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(embed_dedup, "BLOCK", 1024)
    assert small == {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, -1.0])], VECTORS)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD", 300)
    df, x, n = table(spark, 2)
    got = graph_ann.nearest(df, every=30).collect()
    hit = total = 0
    for q in range(0, n, 30):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(n), d))[:10]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(want.tolist())), total + 10
    assert hit / total >= 0.95
    same = [r.vec_id for r in sorted((r for r in got if r.query_id == 420), key=lambda r: r["rank"])]
    assert same == [400 + i for i in range(10)]  # ties to the smaller id
    assert graph_ann.nearest(df.limit(0)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], VECTORS)
    assert [(r.query_id, r["rank"], r.vec_id) for r in graph_ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_graph_reaches_every_row():
    x = np.random.default_rng(3).normal(size=(500, 8))
    graph, start = graph_ann.build(x)
    seen, todo = {start}, [start]
    while todo:
        todo = [j for i in todo for j in graph[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == 500


def test_no_row_holds_a_graph(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(graph_ann, "SHARD", 50)
    monkeypatch.setattr(graph_ann, "SHARDS", 3, raising=False)
    monkeypatch.setattr(graph_ann, "stored", lambda df, name: kept.setdefault(name, df.cache()))
    df, x, n = table(spark, 4)
    got = graph_ann.nearest(df, every=30).where("query_id = 0").collect()
    nodes = kept["graphs"].where("dim = 16")
    sizes = [sum(len(v) for v in r if isinstance(v, bytearray | bytes)) for r in nodes.collect()]
    assert len(sizes) >= 0.9 * n and max(sizes) < 4096  # a row a node, whatever a shard's size
    assert nodes.select("shard").distinct().count() == 3  # a larger table has larger shards first
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    d[0] = np.inf
    assert len({r.vec_id for r in got} & set(d.argsort(kind="stable")[:10].tolist())) >= 9
