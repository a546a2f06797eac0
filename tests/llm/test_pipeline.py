import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{(i * 7919 + j * 104729) % 5003}" for j in range(n))
    passage = words(999, 70)
    docs = [(i, f"{words(i, 80)}\n{words(i + 500, 20)}", "en", "s", 1) for i in range(60)]
    docs += [(100 + i, " ".join(f"{x}%%%" for x in words(i, 60).split()), "en", "s", 1) for i in range(40)]
    docs += [(200, f"{words(200, 30)}\n{passage}", "en", "s", 1), (201, f"{words(201, 30)}\n{passage}", "en", "s", 1), (202, docs[3][1].replace("\n", " ", 1), "en", "s", 1), (203, words(7777, 40) + " token=abcdef123", "en", "s", 1), (204, None, None, None, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    assert not set(range(100, 140)) & set(seen["quality classifier"]) and set(range(60)) <= set(seen["quality classifier"])
    assert passage in seen["line dedup"][200] and passage not in seen["line dedup"][201]
    assert 3 in seen["SimHash near-dedup"] and 202 not in seen["SimHash near-dedup"]
    assert seen["secret scans"][203].endswith("[SECRET]")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(seen["secret scans"])
