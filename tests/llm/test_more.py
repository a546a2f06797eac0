"""Plain versions and odd inputs of the corpus operators."""

import random
import re
import zlib

import numpy as np
import pytest

from riskspark.llm import embed_dedup, graph_ann, html_blocks, lattice_sampling, line_chunks, packing, quality, queries, secret_scan, shared, simhash, toxicity

DOCS = "doc_id long, text string"


def plain_tree(rows, depth):
    """The tree's rule over lists: at each node every split of every feature is weighed by Gini impurity."""

    def grow(rows, depth):
        share = sum(r[-1] for r in rows) / len(rows)
        if depth == 0 or share in (0, 1):
            return lambda x, y=int(share >= 0.5): y
        best = None
        for f in range(len(rows[0]) - 1):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                cost = 0.0
                for part in ([r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]):
                    p = sum(r[-1] for r in part) / len(part)
                    cost += len(part) * p * (1 - p)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, t
        if best is None:
            return lambda x, y=int(share >= 0.5): y
        _, f, t = best
        low, high = grow([r for r in rows if r[f] <= t], depth - 1), grow([r for r in rows if r[f] > t], depth - 1)
        return lambda x: low(x) if x[f] <= t else high(x)

    return grow(rows, depth)


def test_tree_is_the_plain_one():
    rows = html_blocks.labelled()
    tree, plain = html_blocks.train(), plain_tree(rows, 7)
    r = random.Random(1)
    odd = [(r.choice((0, 1, 2)), r.choice((0, 1)), r.choice((0, 1)), r.choice((0, 1)), r.randrange(120), r.random(), r.randrange(90), r.random(), r.randrange(90), r.random()) for _ in range(2000)]
    assert all(html_blocks.classify(tree, x) == plain(x) for x in [*odd, *(x[:-1] for x in rows)])
    assert all(html_blocks.classify(tree, x[:-1]) == x[-1] for x in rows)


def test_blocks_told_apart_by_words_and_links():
    tree, say = html_blocks.train(), "some real words that go on and on in this article about things we care for"
    cases = {
        f'<article><section class="related work"><p>{say}</p></section></article>': say,
        f'<article><ul><li class="share">x<li>{say}</ul></article>': say,
        f'<article><p class="ad">buy it now<p>{say}</article>': say,
        "<article><h2><a href=x>Title</a></h2><p><a href=y>one linked sentence</a></p></article>": "Title one linked sentence",
        f'<article><div class="comments"><p>{say}</p></div><p>Own.</p><ul class="related"><li><a href=x>Other one</a></ul><div class="share">Share this</div></article>': "Own.",
        f"<div><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div><h1>On it</h1><p>{say}</p><p>{say}</p></div><div><a href=c>About us</a> <a href=d>Terms</a></div>": f"On it {say} {say}",
    }
    for page, want in cases.items():
        assert html_blocks.main_text(page, tree) == want


def components(n, edges):
    at = list(range(n))
    while True:
        new = list(at)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new


@pytest.mark.parametrize("share", [0.0, 0.35])
def test_embedding_components(spark, share):
    """All links and components, with a third of the rows in one crowd of near but unequal copies, too."""
    r = np.random.default_rng(7)
    n, dim = 900, 48
    x = r.normal(size=(n, dim))
    hot = int(n * share)
    if hot:
        x[:hot] = r.normal(size=dim) + r.normal(size=(hot, dim)) * 0.16
    for i in range(500, 800, 4):
        x[i + 1 : i + 4] = x[i] + r.normal(size=(3, dim)) * 0.2
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(n, np.argwhere(np.triu(near)).tolist())
    got = {t.vec_id: t for t in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i].component_id for i in range(n)] == want
    assert [got[i].n_links for i in range(n)] == near.sum(1).tolist()


def test_pivots_grow_and_spread(spark):
    assert [embed_dedup.pivots_for(n) for n in (0, 10**4, 10**6, 10**9)] == [64, 64, 203, 4096]
    r = np.random.default_rng(0)
    x = np.concatenate([np.ones((200, 8)) + r.normal(size=(200, 8)) * 0.01, r.normal(size=(100, 8))])
    rows = spark.createDataFrame([(i, 1, v.tolist(), 8) for i, v in enumerate(x)], "rep long, n long, v array<double>, dim int")
    p = embed_dedup.choose_pivots(rows, 12)[8]
    s = p @ p.T
    assert len(p) == 12 and (s[np.triu_indices(12, 1)] >= embed_dedup.SPREAD).sum() == 0


def test_shared_lists_count_a_pair_once():
    a, b = np.array([[1, 4, 6, 9], [1, 2, 3, 4], [0, 1, 2, 3]]), np.array([[0, 4, 6, 9], [1, 7, 8, 9], [0, 1, 2, 3]])
    assert embed_dedup._first_list(a, b).tolist() == [4 * embed_dedup.MOST + 6, -1, 1]


def test_persistent_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "token=abcdefg", 5), ("b", "token=abcdefg", 6), ("c", "plain", 7)], "path string, text string, cuts int")
    assert secret_scan.update_ledger(first, path).count() == 2
    files = len(spark.read.parquet(path).inputFiles())
    assert secret_scan.update_ledger(first, path).count() == 2 and spark.read.parquet(path).count() == 2
    more = first.unionAll(spark.createDataFrame([("d", "secret=1234567", 8), ("e", None, 9)], first.schema))
    assert {t.path: len(t.findings) for t in secret_scan.scan_with_ledger(more, path).collect()} == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 0}
    assert len(spark.read.parquet(path).inputFiles()) > files and spark.read.parquet(path).count() == 4
    found = {(t.path, t.kind) for t in secret_scan.findings_by_path(more, path).collect()}
    assert found == {("a", "assign"), ("b", "assign"), ("d", "assign")}
    spark.read.parquet(path).limit(2).write.mode("append").parquet(path)  # a run that was repeated
    assert secret_scan.scan_with_ledger(more, path).count() == 5


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a token=abcdefg b", "f", 3)], "doc_id long, text string, findings string, cuts int")
    got = secret_scan.redact(df)
    assert got.columns == df.columns and got.first().asDict() == {"doc_id": 1, "text": "a [SECRET] b", "findings": "f", "cuts": 3}


def test_scores_do_not_hang_on_copies_or_order(spark):
    rows = [(i, ("Plain words and so on, well said. " if i % 3 else "junk%%% &&& words$$$ ") * 4 + f"n{i % 7}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    more = [*rows, *[(7, rows[7][1])] * 50, (8, "another text of this id")]
    for op in (quality, toxicity):
        one = {t.doc_id: t.score for t in op.classify(spark.createDataFrame([*rows, (8, "another text of this id")], DOCS), labels).where("doc_id > 10").collect()}
        two = {t.doc_id: t.score for t in op.classify(spark.createDataFrame(more[::-1], DOCS).repartition(3), labels).where("doc_id > 10").collect()}
        assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-6) for i in one)


def test_very_long_texts(spark):
    words = " ".join(f"w{i % 9973}x{i % 31}" for i in range(150_000))
    rows = [(1, words), (2, words + " end"), (3, "x" * 300_000), (4, None), (5, "short one here")]
    df = spark.createDataFrame(rows, DOCS)
    assert {t.doc_id: t.component_id for t in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, labels).count() == 5 and toxicity.classify(df, labels).count() == 5
    assert line_chunks.deduplicate(df.unionAll(df.where("doc_id = 1").selectExpr("9L", "text")), passages=True).where("doc_id = 9").first().text == ""


def test_repeated_rows_do_not_share_a_part(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    df = spark.createDataFrame([(1, "same text")] * 1000, DOCS)
    path = queries.tokenizer_path("word_bpe_49k.json")
    cut = packing.pieces(df, path)
    assert cut.count() == 1000 and cut.select("salt").distinct().count() > 100
    assert packing.pack(df, path).groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_pipeline_stages_on_odd_input(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = "doc_id long, text string, n_chars long, score string, findings int, cuts int, spans int, fp int, c int, k int, part int, salt int, x int"
    rows = [(1, "a few words here", 16, "s", 1, 2, 3, 4, 5, 6, 7, 8, 9)] * 2 + [(None, None, None, None, 1, 2, 3, 4, 5, 6, 7, 8, 9), (2, "", 0, "t", 1, 2, 3, 4, 5, 6, 7, 8, 9)]
    for data in (rows, []):
        df = spark.createDataFrame(data, names)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and out.dtypes == df.dtypes
            assert {t.score for t in out.collect()} <= {"s", "t", None}
        corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()


def test_what_is_stored_can_be_dropped(spark):
    df = shared.stored(spark.range(3), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert shared.exists(spark, path)
    assert shared.drop_stored(spark) >= 1 and not shared.exists(spark, path) and shared.drop_stored(spark) == 0


def test_queries_of_a_repeated_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [0.0, 2.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = [(t.query_id, t["rank"], t.vec_id) for t in graph_ann.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]  # the least vector, (0, 3), asks


def test_links_by_sql(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(3)
    x = r.normal(size=(200, 12))
    for i in range(0, 120, 3):
        x[i + 1], x[i + 2] = x[i] + r.normal(size=12) * 0.2, x[max(0, i - 3)] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(c.sql(queries.oracle_sql()["op2_embed_dedup"]).fetchall())
    got = sorted(tuple(t) for t in queries.op2_embed_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(t[1] for t in want) > 100


def test_a_worker_gives_memory_back():
    psutil = pytest.importorskip("psutil")

    def run(batches):
        for _ in batches:
            rows = [np.zeros(100) for _ in range(300_000)]
            yield [rows[-1]]  # stays at the heap's end

    def held(f):
        before = psutil.Process().memory_info().rss
        out = list(f([1]))
        return (psutil.Process().memory_info().rss - before) / 1e6 if out else 0

    assert held(shared.tidied(run)) < 60


def test_sampling_draws_noise_for_all_texts_at_once(monkeypatch):
    lat = lattice_sampling.lattice(queries.tokenizer_path("piece_bpe_32k.model"))
    texts, keys = ["some words and words", "", "other words\nhere"], np.arange(3, dtype=np.uint64)
    calls, mix = [], lattice_sampling._mix
    alone = [lattice_sampling.sample_batch(lat, [t], keys[i : i + 1], 3)[0] for i, t in enumerate(texts)]
    monkeypatch.setattr(lattice_sampling, "_mix", lambda x: calls.append(1) or mix(x))
    for n in (1, 9):
        calls.clear()
        got = lattice_sampling.sample_batch(lat, texts * n, np.tile(keys, n), 1)
        assert len(calls) < 30  # a turn's noise is drawn for all texts at once
    both = lattice_sampling.sample_batch(lat, texts, keys, 3)
    for x, y in zip(alone, both):
        assert [a[0].tolist() for a in x] == [b[0].tolist() for b in y] and np.allclose([a[1:] for a in x], [b[1:] for b in y])
    assert [len(x) for x in got] == [1] * 27


def test_chunks_as_the_pattern_finds_them():
    rng = random.Random(5)
    odd = ["", " ", "  ", "\n", "a", " a", "a ", "a\n", "\na", "a \n b", "a\n\n b", "▁", "a▁b", "a▁ b", "\t a\rb c\x0b", "\n \n", " \n", "\n "]
    for t in odd + ["".join(rng.choice(["a", "bc", " ", " ", "\n", "é▁"[rng.randrange(2)], "\t"]) for _ in range(rng.randrange(12))) for _ in range(3000)]:
        assert lattice_sampling._cut(t) == (lattice_sampling._CHUNK.findall("▁" + t.replace(" ", "▁")) if t else []), repr(t)


def test_noise_is_drawn_for_all_texts_at_once(monkeypatch):
    lat = lattice_sampling.lattice(queries.tokenizer_path("piece_bpe_32k.model"))
    mix, calls = lattice_sampling._mix, []
    monkeypatch.setattr(lattice_sampling, "_mix", lambda x: calls.append(1) or mix(x))
    used = []
    for n in (4, 40):
        calls.clear()
        lattice_sampling.sample_batch(lat, ["three small words"] * n, np.zeros(n, np.uint64), 3)
        used.append(len(calls))
    assert used[0] == used[1]


def test_samples_whatever_the_lattice_keeps(monkeypatch):
    lat = lattice_sampling.Lattice(queries.tokenizer_path("piece_bpe_32k.model"))
    texts = ["some words\nand  more", "x" * 90 + " and words", "", "other words " + "y" * 50]
    keys = np.arange(4, dtype=np.uint64)

    def flat():
        return [(ids.tolist(), *rest) for found in lattice_sampling.sample_batch(lat, texts, keys, 3) for ids, *rest in found]

    first = flat()
    assert flat() == first and not lat.long and "▁words" in lat.known and "▁" + "x" * 90 not in lat.known
    monkeypatch.setattr(lattice_sampling, "KEEP", 0)
    assert flat() == first
    monkeypatch.setattr(lat, "_fits", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lattice_sampling.sample_batch(lat, ["a new▁word"], keys[:1], 3)
    monkeypatch.undo()
    assert flat() == first


def test_a_lattice_takes_little_memory(monkeypatch):
    psutil = pytest.importorskip("psutil")
    lat, rng = lattice_sampling.Lattice(queries.tokenizer_path("piece_bpe_32k.model")), random.Random(3)
    before, most = psutil.Process().memory_info().rss, 0
    for _ in range(16):  # 3.2 million nodes
        lat.learn([["▁" + "".join(rng.choices("etaoinshr", k=9)) for _ in range(20_000)]])
        most = max(most, psutil.Process().memory_info().rss - before)
    assert most < 220e6

    monkeypatch.setattr(lattice_sampling, "KEEP", 40_000)
    keys, texts = np.zeros(1, np.uint64), ["some words " * 3]

    def flat():
        return [(ids.tolist(), *rest) for ids, *rest in lattice_sampling.sample_batch(lat, texts, keys, 3)[0]]

    first = flat()
    lat.learn([["x" * 100_000]])
    assert len(lat.cum) > 320_000
    assert flat() == first and len(lat.cum) < 320_000  # a long text's room is given back
