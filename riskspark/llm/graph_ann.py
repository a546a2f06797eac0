"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .vectors import usable

#: Rows of a shard, about: the least, what a table of SHARDS of them has, and the most. A query searches every shard, so
#: a larger table gets larger shards before it gets more of them.
SHARD, SHARDS, LARGEST = 4096, 64, 65536
#: Out-degree, and what it may grow by before a node is pruned again; beam while building and while searching; the
#: relaxation of pruning.
DEGREE, SLACK, BUILD, BEAM, ALPHA = 32, 16, 64, 160, 1.2
#: Queries searched together, and neighbours asked for.
BLOCK, NEAREST = 512, 10


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q, the `width` nearest nodes met and their squared distances, by greedy best-first search.

    graph has a node's neighbours in a row, -1 after the last. All queries advance together, one expansion each a turn,
    until none has an unexpanded node in its beam.
    """
    n, m = len(q), len(x)
    width = min(width, m)
    norm, qn = (x * x).sum(1), (q * q).sum(1)
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf)
    open_ = np.zeros((n, width), bool)
    ids[:, 0] = start
    dist[:, 0] = norm[start] - 2 * (q @ x[start]) + qn
    open_[:, 0] = True
    met = np.zeros((n, m + 1), bool)
    met[:, m] = True
    met[:, start] = True
    live = np.arange(n)
    while len(live):
        d = np.where(open_[live], dist[live], np.inf)
        at = d.argmin(1)
        node = ids[live, at]
        open_[live, at] = False
        near = graph[node]
        near = np.where(near < 0, m, near)
        fresh = ~met[live[:, None], near]
        near = np.where(fresh, near, m)
        met[live[:, None], near] = True
        safe = np.minimum(near, m - 1)
        far = norm[safe] - 2 * np.einsum("bkd,bd->bk", x[safe], q[live]) + qn[live][:, None]
        far = np.where(near < m, far, np.inf)
        all_d = np.concatenate([dist[live], far], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_o = np.concatenate([open_[live], near < m], 1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(all_i, best, 1)
        open_[live] = np.take_along_axis(all_o, best, 1) & np.isfinite(dist[live])
        live = live[open_[live].any(1)]
    return ids, dist


def robust_prune(x: np.ndarray, node: int, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of near, the nodes that no chosen, nearer node stands for: one alpha times closer to them than `node` is."""
    near = np.unique(near[(near >= 0) & (near != node)])
    if not len(near):
        return near
    d = ((x[near] - x[node]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    near, d = near[order], d[order]
    points = x[near]
    between = (points * points).sum(1)
    between = between[:, None] + between[None] - 2 * points @ points.T
    alive, chosen = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            chosen.append(near[i])
            if len(chosen) == degree:
                break
            alive &= alpha * alpha * between[i] > d
    return np.array(chosen, np.int64)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph of the rows of x and its entry, the row nearest to their mean.

    Two passes over the rows in a seeded order, in batches: each row is searched for in the graph so far, its neighbours
    are pruned (first without, then with relaxation), and it is put back to them. A row with more than SLACK neighbours
    over `degree` is pruned at once, the others at the end. Rows that no path reaches are linked from the nearest row
    that one does.
    """
    m, most = len(x), degree + SLACK
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((m, most), -1, np.int32)
    rng = np.random.default_rng(seed)
    for i in range(m):
        k = min(degree // 2, m - 1)
        pick = rng.integers(0, m - 1, k) if k else np.zeros(0, np.int64)
        pick = np.unique(pick + (pick >= i))
        graph[i, : len(pick)] = pick
    for a in (1.0, alpha):
        order = rng.permutation(m)
        for lo in range(0, m, 256):
            batch = order[lo : lo + 256]
            found, _ = beam_search(x, graph, start, x[batch], beam)
            back: dict[int, list[int]] = {}
            for i, f in zip(batch.tolist(), found):
                chosen = robust_prune(x, i, np.concatenate([f, graph[i]]), degree, a)
                graph[i] = -1
                graph[i, : len(chosen)] = chosen
                for j in chosen.tolist():
                    back.setdefault(j, []).append(i)
            for j, new in back.items():
                all_ = np.union1d(graph[j][graph[j] >= 0], new)
                all_ = all_[all_ != j]
                if len(all_) > most:
                    all_ = robust_prune(x, j, all_, degree, a)
                graph[j] = -1
                graph[j, : len(all_)] = all_
    for i in np.flatnonzero((graph >= 0).sum(1) > degree).tolist():
        chosen = robust_prune(x, i, graph[i], degree, alpha)
        graph[i] = -1
        graph[i, : len(chosen)] = chosen
    return _reachable(x, np.ascontiguousarray(graph[:, :degree]), start), start


def _reachable(x: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    m = len(x)
    while True:
        seen, todo = np.zeros(m, bool), np.array([start])
        seen[start] = True
        while len(todo):
            nxt = np.unique(graph[todo])
            todo = nxt[(nxt >= 0) & ~seen[nxt]]
            seen[todo] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        reached = np.flatnonzero(seen)
        i = lost[0]
        order = reached[np.argsort(((x[reached] - x[i]) ** 2).sum(1), kind="stable")]
        full = (graph[order] >= 0).all(1)
        if full.all():
            graph = np.pad(graph, ((0, 0), (0, 1)), constant_values=-1)
            j = order[0]
        else:
            j = order[np.flatnonzero(~full)[0]]
        graph[j, np.flatnonzero(graph[j] < 0)[0]] = i


def _packed(values: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    raw, n = values.tobytes(), values.itemsize * values.shape[1]
    return [raw[i * n : (i + 1) * n] for i in range(len(values))]


def index(rows: DataFrame, shards: int, kind: str) -> DataFrame:
    """One graph a shard, a row a node: (dim, shard, node, ids, v, graph, start). Equal vectors are one node with all their
    ids; v has components of the type `kind`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf.dim.iloc[0])
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        x, at = np.unique(np.frombuffer(b"".join(pdf.v), kind).reshape(-1, dim).astype(float), axis=0, return_inverse=True)
        graph, start = build(x)
        ids = pdf.vec_id.to_numpy("<i8")[np.argsort(at.ravel(), kind="stable")]  # they ascend within a node
        ends = np.cumsum(np.bincount(at.ravel(), minlength=len(x)))
        ids = [i.tobytes() for i in np.split(ids, ends[:-1])]
        return pd.DataFrame({"dim": dim, "shard": int(pdf.shard.iloc[0]), "node": np.arange(len(x)), "ids": ids, "v": _packed(x.astype(kind)), "graph": _packed(graph.astype("<i4")), "start": start})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(shards, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, node long, ids binary, v binary, graph binary, start int")


def _as_bytes(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.append(0, np.cumsum(b.column(2).to_numpy()) * values.itemsize).astype("<i4")
            v = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), v, b.column(2)], ["vec_id", "v", "dim"])

    return rows.select("vec_id", "v", "dim").mapInArrow(run, "vec_id long, v binary, dim int")


class _Shard:
    """A graph read again from its nodes' rows."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, kind: str) -> None:
        read = lambda name, t: np.frombuffer(b"".join(x for p in parts for x in p.column(name).to_pylist()), t)
        self.x = read("v", kind).reshape(-1, dim).astype(float)
        self.graph = read("graph", "<i4").reshape(len(self.x), -1)
        self.ids = read("ids", "<i8")
        self.first = np.append(0, np.cumsum([len(x) // 8 for p in parts for x in p.column("ids").to_pylist()]))
        self.start = parts[0].column("start")[0].as_py()

    def nearest(self, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        near, dist = beam_search(self.x, self.graph, self.start, q, BEAM)
        out = {"query_id": [], "vec_id": [], "score": []}
        for i in range(len(q)):
            nodes = near[i][np.argsort(dist[i], kind="stable")][: 2 * NEAREST + 1]
            nodes = nodes[(nodes >= 0) & (nodes < len(self.x))]
            exact = np.sqrt(((self.x[nodes] - q[i]) ** 2).sum(1))
            rows = [(d, int(v)) for d, k in zip(exact.tolist(), nodes.tolist()) for v in self.ids[self.first[k] : self.first[k + 1]][: NEAREST + 1] if v != qid[i]]
            for d, v in sorted(rows)[:NEAREST]:
                out["query_id"].append(int(qid[i])), out["vec_id"].append(v), out["score"].append(d)
        return pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], ["query_id", "vec_id", "score"])


def _search(kind: str):
    """Over rows in order of (dim, shard, asks, node): a shard's nodes are read into a graph, then its queries run on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in batches:
            where = np.stack([b.column(n).to_numpy() for n in ("dim", "shard", "asks")], 1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                dim, number, asks = where[lo].tolist()
                if (dim, number) != at:
                    at, parts, shard = (dim, number), [], None
                if not asks:
                    parts.append(b.slice(lo, hi - lo))
                    continue
                if shard is None and parts:
                    shard, parts = _Shard(parts, dim, kind), []
                for i in range(lo, hi if shard else lo, BLOCK):
                    some = b.slice(i, min(BLOCK, hi - i))
                    q = np.frombuffer(b"".join(some.column("v").to_pylist()), kind).reshape(-1, dim).astype(float)
                    yield shard.nearest(some.column("node").to_numpy(), q)

    return run


def nearest(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding): the 10 nearest found of each query's others.

    Queries are the rows whose vec_id is divisible by `every`; nearness is Euclidean distance in double precision on the
    vectors as they are, ties to the smaller vec_id. Rows are dealt to shards of 4096 to 65536 by the id's hash, so equal
    vectors spread out; every shard gets a graph and every query searches every shard of its length. A shard's nodes and
    its queries travel as rows of their own, which a task reads one after the other: no row holds a whole graph. Fewer
    than 10 others give fewer rows. Vectors that are null, zero or hold null or non-finite components take no part, nor
    do null ids. Of several rows of a query's id the shortest, then least vector asks, and none of them is its
    neighbour; other repeated rows are one more candidate each.
    """
    rows = usable(vectors)
    total = rows.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = -(-total // max(SHARD, min(LARGEST, -(-total // SHARDS))))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    plain = stored(_as_bytes(rows, kind), "vectors")
    graphs = stored(index(plain, shards, kind), "graphs")
    asked = plain.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    nodes = graphs.select("dim", "shard", F.lit(0).alias("asks"), "node", "ids", "v", "graph", "start")
    none = F.lit(None)
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = asked.select("dim", every_shard, F.lit(1).alias("asks"), F.col("vec_id").alias("node"), none.cast("binary").alias("ids"), "v", none.cast("binary").alias("graph"), none.cast("int").alias("start"))
    order = ["dim", "shard", "asks", "node"]
    dealt = nodes.unionAll(asking).repartition(shards, "dim", "shard").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_search(kind), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
