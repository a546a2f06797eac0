import random

import numpy as np
import xxhash

from riskspark.llm import simhash
from riskspark.llm.components import connected_components


def plain(text: str, words: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(ids, edges):
    at = {i: i for i in ids}
    while True:
        new = dict(at)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new


def test_fingerprint():
    for t in ("", " \t\n", "One", "a b", "É x\x0by Z\x1cq  a b c d", "the cat " * 400):
        assert simhash.fingerprint(t.encode()) == plain(t)
    assert simhash.fingerprint(None) == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({i for e in edges for i in e}, edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_those_of_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {f for b in base for f in [b, *(b ^ sum(1 << x for x in r.sample(range(64), k)) for k in (1, 1, 2, 2, 3, 4) for _ in range(2))]}
    hot = r.getrandbits(64)
    fps |= {hot ^ (1 << i) ^ (1 << j) for i in range(4) for j in range(20, 64)}  # more than a bucket holds
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(sorted(fps))]
    for bucket in (64, 3):
        found = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"), bucket).collect()
        want = [(i, j) for i, a in enumerate(sorted(fps)) for j, b in enumerate(sorted(fps)) if i < j and (a ^ b).bit_count() <= 2]
        assert groups(range(len(fps)), [(x.a, x.b) for x in found]) == groups(range(len(fps)), want)


def test_near_duplicates_edge_cases(spark):
    rows = [(5, "the quick brown fox"), (2, "The  QUICK brown\nfox"), (2, "The  QUICK brown\nfox"), (9, None), (7, ""), (8, "else entirely now"), (None, "the quick brown fox")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as k", "3 as component_id")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.component_id) for x in simhash.near_duplicates(df).collect())
    assert got == [(False, 2, 2), (False, 2, 2), (False, 5, 2), (False, 7, 7), (False, 8, 8), (False, 9, 7), (True, 0, 2)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    doc = lambda: [r.choice(words) for _ in range(200)]
    a, clean = doc(), [doc() for _ in range(10)]
    near = [a[:i] + ["changed"] + a[i + 1 :] for i in range(3, 180, 9)]  # one word each: 5 of 196 shingles
    far = a[:60] + doc()[:140]
    rows = [(i, " ".join(t)) for i, t in enumerate([a, *near, far, *clean])] + [(None, "x"), (3, " ".join(near[2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as n_chars")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect() if x.doc_id is not None) == [0, *range(len(near) + 1, len(near) + 12)]
    assert out.where("doc_id is null").count() == 1
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_similar_links_are_those_of_all_candidates(spark):
    r = random.Random(7)

    def changed(t, n, mark):
        t, o = list(t), r.randrange(8)
        for i in range(n):
            t[o + 232 * i // n] = f"{mark}x{i}"
        return t

    texts = []
    for p in range(100):  # pairs above 0.8 amid texts of one template that lie mostly below
        one = changed([f"t{i}" for i in range(240)], 5, f"p{p}")
        texts += [one, changed(one, 4, f"q{p}")]
    r.shuffle(texts)
    rows = [(i, " ".join(t).encode()) for i, t in enumerate(texts)]
    reps = spark.createDataFrame(rows, "doc_id long, text binary")
    at = {}
    for x in simhash._bands(reps).collect():
        at.setdefault(x.k, []).append(x.doc_id)
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= simhash.SIMILAR * len(sets[a] | sets[b])
    want = [(a, b) for a, b in {(a, b) for m in at.values() for a in m for b in m if a < b} if near(a, b)]
    assert len(want) > 400
    for how in ({}, {"block": 16}):
        got = [(x.a, x.b) for x in simhash.similar_links(reps, **how).collect()]
        assert all(near(a, b) for a, b in got)
        assert groups(range(len(rows)), got) == groups(range(len(rows)), want)


def test_stage_groups_are_those_of_all_pairs(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):  # drifting edits: later ones resemble the one before, not the first
        t = [r.choice(words) for _ in range(r.choice((60, 150)))]
        for _ in range(5):
            texts.append(" ".join(t))
            t = list(t)
            for _ in range(r.choice((1, 2, 3))):
                t[r.randrange(len(t))] = r.choice(words)
    texts += ["", None, texts[0], texts[7].upper(), "one word", "One  word"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [*zip(ids, texts), (ids[3], texts[3])]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    fps, sets = [plain(t or "") for t in texts], [set(simhash.shingle_set((t or "").encode()).tolist()) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    links = [(ids[i], ids[j]) for i in range(len(texts)) for j in range(i) if near(i, j)]
    want = groups(ids, links)
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 and bool(near(i, j)) for i in range(len(texts)) for j in range(i)) > 20
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(want.values()))


def test_a_repeated_doc_id_keeps_one_text_however_rows_lie(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "eta theta iota kappa lambda mu"), (2, "nu xi omicron pi rho sigma"), (2, None)]
    kept = [sorted((x.doc_id, x.text) for x in simhash.deduplicate(spark.createDataFrame(o, "doc_id long, text string").repartition(n)).collect()) for o, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and [x[0] for x in kept[0]] == [1, 2]
