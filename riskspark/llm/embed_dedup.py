"""Near-duplicate embeddings through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stored
from .vectors import matrix, unit, unusable, usable

#: Reference points at least and at most, how many of the nearest describe a vector, and how many of them two vectors
#: must share. A pair of shared pivots names an inverted list.
PIVOTS, MOST, PREFIX, SHARED = 64, 4096, 7, 2
#: Reference points are no nearer to each other than this cosine, so that a crowd of near copies takes one of them.
SPREAD = 0.9
COSINE = 0.95
#: Vectors of one list that are compared as one block; the number of pivots is such that a usual list is about one.
BLOCK = 1024


def pivots_for(vectors: int) -> int:
    """So many pivots that a pair of them lists about BLOCK vectors: their number grows with the root of the rows, and the
    comparisons in proportion to the rows, up to MOST pivots (about 400 million vectors). Beyond, lists grow."""
    return int(min(MOST, max(PIVOTS, np.ceil(np.sqrt(PREFIX * (PREFIX - 1) * vectors / BLOCK)))))


def choose_pivots(classes: DataFrame, number: int | None = None) -> dict[int, np.ndarray]:
    """By dimension, at most `number` vectors: of the 4 x number with the least hash those that keep SPREAD, taken in
    turn, then the others. They depend on the set of vectors alone."""
    rows = classes.select("dim", "v", F.xxhash64("v").alias("h"))
    sizes = rows.groupBy("dim").count().orderBy("dim").limit(64).collect()
    found = {}
    for d, n in ((r["dim"], r["count"]) for r in sizes):
        want = number or pivots_for(n)
        x = unit(np.array([r.v for r in rows.where(F.col("dim") == d).orderBy("h", "v").limit(4 * want).collect()], "f8"))
        nearest, chosen = np.full(len(x), -1.0), []
        for i in range(len(x)):
            if nearest[i] < SPREAD:
                chosen.append(i)
                nearest = np.maximum(nearest, x @ x[i])
                if len(chosen) == want:
                    break
        rest = np.setdiff1d(np.arange(len(x)), chosen)[: want - len(chosen)]
        found[d] = x[[*chosen, *rest.tolist()]]
    return found


def describe(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """classes (rep, n, v, dim) with each vector's PREFIX nearest pivots (`near`, nearest first) and the inverted lists it
    is filed under: the pairs of these. Two vectors meet in some list exactly if they share two pivots."""
    schema = "rep long, n long, dim int, near array<int>, v binary, list long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, n, dim = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            vectors = b.column(2)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))
                p = pivots.get(int(d))
                if p is None:  # a length beyond the first 64: one pivot, one list
                    p = np.ones((1, int(d)))
                near = np.argsort(-(unit(x) @ p.T), axis=1, kind="stable")[:, :PREFIX].astype(np.int64)
                low = np.sort(near, axis=1)
                pairs = list(combinations(range(low.shape[1]), SHARED)) or [(0, 0)]
                lists = np.stack([low[:, i] * MOST + low[:, j] for i, j in pairs], 1)
                k = lists.shape[1]
                own = near.astype(np.int32).tolist()
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rep[at], k)), pa.array(np.repeat(n[at], k)), pa.array(np.full(len(at) * k, d, np.int32)), pa.array([o for o in own for _ in range(k)], pa.list_(pa.int32())), pa.array([r for r in raw for _ in range(k)], pa.binary()), pa.array(lists.ravel())],
                    ["rep", "n", "dim", "near", "v", "list"],
                )

    return classes.select("rep", "n", "v", "dim").mapInArrow(run, schema)


def _first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of two sets of pivots, each ascending: the list of the two lowest that they share (of one, if they have no
    more); -1 where fewer than SHARED are shared."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    count = both.sum(1)
    rows = np.arange(len(a))
    first = both.argmax(1)
    rest = both.copy()
    rest[rows, first] = False
    second = np.where(count > 1, rest.argmax(1), first)
    return np.where(count >= min(SHARED, a.shape[1]), a[rows, first] * MOST + a[rows, second], -1)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a pair of blocks of one list: the weights that each vector gains, and a spanning forest of them.

    A pair counts only in the first of the lists that it shares, so it counts once in all.
    """
    dim, own = int(pdf.dim.iloc[0]), int(pdf.list.iloc[0])
    i, j = int(pdf.bi.iloc[0]), int(pdf.bj.iloc[0])
    pdf = pdf.sort_values("rep", ignore_index=True)
    left, right = (pdf, pdf) if i == j else (pdf[pdf.block == i], pdf[pdf.block == j])
    out = {"a": [], "b": [], "w": []}
    if len(left) and len(right):
        x, y = unit(matrix(left.v, dim)), unit(matrix(right.v, dim))
        lr, rr = left.rep.to_numpy(), right.rep.to_numpy()
        lm, rm = (np.sort(np.stack(part.near.to_list()).astype(np.int64), axis=1) for part in (left, right))
        gain_l, gain_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        ln, rn = left.n.to_numpy(np.int64), right.n.to_numpy(np.int64)
        parent = {int(r): int(r) for r in (*lr, *rr)}

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for lo in range(0, len(left), 512):
            near = x[lo : lo + 512] @ y.T >= COSINE
            p, q = np.nonzero(near)
            p = p + lo
            if i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                ok = np.concatenate([_first_list(lm[p[k : k + 65536]], rm[q[k : k + 65536]]) == own for k in range(0, len(p), 65536)])
                p, q = p[ok], q[ok]
            np.add.at(gain_l, p, rn[q])
            np.add.at(gain_r, q, ln[p])
            for a, b in zip(lr[p].tolist(), rr[q].tolist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out["a"].append(a), out["b"].append(b), out["w"].append(0)
        for reps, gain in ((lr, gain_l), (rr, gain_r)):
            at = np.flatnonzero(gain)
            out["a"] += reps[at].tolist()
            out["b"] += reps[at].tolist()
            out["w"] += gain[at].tolist()
    return pd.DataFrame(out).astype("int64")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Vectors link if their cosine in double precision is 0.95 or more, whatever their labels; n_links is the number of
    other rows linked directly, component_id the least vec_id reachable. Equal vectors form one class with a weight and
    never become pairs. Long inverted lists are cut into blocks, so no list is gathered; a pair of blocks gives back
    sums and a spanning forest, never its pairs. Null, zero, non-finite and odd vectors, and those of another length,
    link with nothing: such a row has no links and is its own component. A null vec_id takes no part and has a null
    component.
    """
    rows = usable(vectors)
    classes = stored(rows.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    pivots = choose_pivots(classes)
    filed = stored(describe(classes, pivots), "filed")
    long_ = filed.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("nb > 1")
    blocks = filed.join(long_, ["dim", "list"], "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("bi"), F.greatest(F.col("block"), k).alias("bj")))
    dealt = blocks.withColumn("o", F.explode(other)).select("dim", "list", "o.bi", "o.bj", "block", "rep", "n", "near", "v")
    found = stored(dealt.groupBy("dim", "list", "bi", "bj").applyInPandas(_compare, "a long, b long, w long"), "links")
    degree = found.where("w > 0").groupBy("a").agg(F.sum("w").alias("w"))
    parts = connected_components(found.where("w = 0").select("a", "b"))
    named = classes.join(degree, classes.rep == degree.a, "left").join(parts, classes.rep == parts.node, "left")
    named = named.select("v", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    seen = rows.select("vec_id", "v").join(named, "v").select("vec_id", "n_links", "component_id")
    apart = unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return seen.unionAll(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

