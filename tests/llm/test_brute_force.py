"""Queries over whole test tables against plain versions."""

import os
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import line_chunks, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_line_dedup(rows):
    """rows: (doc_id, text). Chunks by the stated rules, matched by their text; the least (doc_id, hash, line) stays."""
    hash_ = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    found, of = {}, {}
    for i, text in rows:
        lines = text.split("\n")
        h = [hash_(t.encode()) for t in lines]
        long = [t.count(" ") >= 50 for t in lines]
        ends = []
        for k in range(len(lines)):
            pair = hash_(struct.pack("<Q", h[k]), hash_(struct.pack("<Q", h[k - 1] if k else 0)))
            if k == len(lines) - 1 or long[k] or long[k + 1] or signed(pair) % 4 == 0:
                ends.append(k)
        begin = 0
        for e in ends:
            if long[begin] or (e > begin and sum(map(len, lines[begin : e + 1])) >= 40):
                place = (i, signed(hash_(text.encode())), begin)
                found.setdefault("\n".join(lines[begin : e + 1]), []).append(place)
                of[place] = e
            begin = e + 1
    gone = {}
    for places in found.values():
        for p in sorted(set(places))[1:]:
            gone.setdefault(p[0], set()).update(range(p[2], of[p] + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


@pytest.mark.parametrize("copies", [1, 3])
def test_line_dedup(spark, copies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars")
    for k in range(1, copies):  # the same texts again, and their second halves under other starts
        more = docs.where(f"doc_id < 100 * {k}").selectExpr(f"doc_id + 1000 * {k} as doc_id", "concat('start ', doc_id, '\\n', substr(text, length(text) div 2)) as text", "n_chars")
        docs = docs.unionAll(more).unionAll(docs.where("doc_id < 20").selectExpr(f"doc_id + 5000 * {k} as doc_id", "text", "n_chars"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    want = plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.text, r.n_chars) for r in line_chunks.deduplicate(docs).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


def test_query_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
