"""Segmentations sampled without replacement: Gumbel top-k by a perturbed A-star search over the lattice of pieces."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, tidied

SAMPLES, SEED = 3, 20_240_101
#: Chunks of a text between which no piece lies: pieces hold the space mark only at their start, and no line break.
_CHUNK = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
_SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double"
#: Nodes kept for reuse, of about 64 bytes with their edges; chunks of more characters than this are not kept.
KEEP, KEPT_LENGTH = 700_000, 40
#: Characters of the texts that are sampled together; one text is taken whole, however long.
TOGETHER = 100_000
#: Symbols whose steps down the trie are a table's columns.
COMMON = 128
_models: dict = {}
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """In the open interval from 0 to 1."""
    return ((_mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _cut(text: str) -> list[str]:
    """The chunks of a text, as _CHUNK finds them in it with marks for its spaces and one before it; split at spaces
    where no two marks meet, which is faster."""
    if not text:
        return []
    marked = f" {text}".replace("▁", " ")
    if "  " in marked:
        return _CHUNK.findall(marked.replace(" ", "▁"))
    found = marked[1:].replace(" ", " ▁").replace("\n", " \n ").split(" ")
    found[0] = f"▁{found[0]}"
    return [c for c in found if c] if "\n\n" in text or "\n " in marked or text[-1] == "\n" else found


class _Numbers(dict):
    """Gives each key that is looked up a number, new ones rising ones, and lists the new keys."""

    def __init__(self) -> None:
        self.count, self.new = 0, []

    def __missing__(self, key: str) -> int:
        n = self[key] = self.count
        self.count += 1
        self.new.append(key)
        return n


class Lattice:
    """The graph of all segmentations of each chunk seen, as flat arrays.

    A node is a place in a chunk; its edges are the pieces that fit there, each with its chance given all that may
    follow. A piece weighs 1 / (1 + its rank in the vocabulary); a character that no piece holds is its UTF-8 bytes,
    each of which weighs 1 / (1 + the size of the vocabulary).
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes = {}
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.ids[piece] = i
        low = min(self.ids.values())
        self.weight = {i: 1.0 / (2.0 + i - low) for i in self.ids.values()}
        self.byte_weight = 1.0 / (1.0 + n)
        self.log_weight = np.full(n, np.log(self.byte_weight))
        for i, w in self.weight.items():
            self.log_weight[i] = np.log(w)
        self._trie()
        self.cum = np.empty(0)
        self._reset()

    def _trie(self) -> None:
        """The pieces' prefixes as a trie over symbols: a known character, or a byte of an unknown one.

        Node 0 is the root; nodes that have children come first. `step` has a place for each of them and each of the
        COMMON most usual symbols; the other children lie in a sorted list of (node, symbol).
        """
        prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        usual = Counter(p[-1] for p in prefixes)
        symbols = {c: i for i, (c, _) in enumerate(sorted(usual.items(), key=lambda x: (-x[1], x[0])), 1) if c in self.ids}
        prefixes = {p for p in prefixes if all(c in symbols for c in p)}
        self.symbol = np.zeros(0x110000, np.uint16)
        for c, i in symbols.items():
            self.symbol[ord(c)] = i
        first = max(symbols.values()) + 1
        self.byte_symbol = np.arange(first, first + 256, dtype=np.uint16)
        inner = sorted({p[:-1] for p in prefixes} | {""})
        place = {p: i for i, p in enumerate([*inner, *sorted(prefixes.difference(inner))])}
        self.inner, self.longest = len(inner), max(map(len, prefixes))
        self.ends = np.full(len(place) + 256, -1, np.int32)
        self.step = np.zeros(len(inner) * COMMON, np.min_scalar_type(len(self.ends)))
        rest = [(first + b, len(place) + b) for b in self.bytes]
        for p, i in place.items():
            self.ends[i] = self.ids.get(p, -1)
            if p:
                at, s = place[p[:-1]], symbols[p[-1]]
                if s < COMMON:
                    self.step[at * COMMON + s] = i
                else:
                    rest.append(((at << 16) + s, i))
        for b, i in self.bytes.items():
            self.ends[len(place) + b] = i
        rest.sort()
        self.rare, self.rare_to = np.array([k for k, _ in rest], np.int64), np.array([i for _, i in rest], np.int32)

    def _reset(self) -> None:
        self.known = _Numbers()
        if not 0 < len(self.cum) <= 8 * KEEP:  # also after a very long text, whose room is given back
            self.start, self.first = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
            self.cum, self.chance = np.empty(1 << 18), np.empty(1 << 18)
            self.to, self.piece = np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)
        self.long: list[str] = []
        self.nodes = self.edges = 0

    def _symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all chunks in a row, and each chunk's number of them."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out = self.symbol[codes]
        odd = np.flatnonzero(out == 0)
        if not len(odd):
            return out, length
        raw = {c: np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in np.unique(codes[odd]).tolist()}
        count = np.ones(len(codes), np.int64)
        count[odd] = [len(raw[c]) for c in codes[odd].tolist()]
        out, at = np.repeat(out, count), np.cumsum(count) - count
        for c, r in raw.items():
            out[(at[odd[codes[odd] == c]][:, None] + np.arange(len(r))).ravel()] = np.tile(self.byte_symbol[r], int((codes[odd] == c).sum()))
        return out, np.add.reduceat(count, np.cumsum(length) - length)

    def _fits(self, symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that fit at each place: their number by place, and in order of place and length their ids and ends.

        All places go down the trie together, a symbol a turn.
        """
        at, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        found, width = [], np.zeros(len(symbols), np.int64)
        for depth in range(1, self.longest + 1):
            s = symbols[at + (depth - 1)]
            usual = s < COMMON
            child = self.step.take(node * COMMON + np.where(usual, s, 0))
            odd = np.flatnonzero(~usual)
            if len(odd):
                key = (node[odd] << 16) + s[odd]
                k = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
                child[odd] = np.where(self.rare[k] == key, self.rare_to[k], 0)
            on = np.flatnonzero(child)
            at, node = at[on], child[on].astype(np.int64)
            piece = self.ends[node]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], piece[whole]))
            width[at[whole]] += 1
            on = np.flatnonzero((node < self.inner) & (left[at] > depth))
            at, node = at[on], node[on]
            if not len(at):
                break
        free = np.cumsum(width) - width
        piece, end = np.empty(int(width.sum()), np.int32), np.empty(int(width.sum()), np.int64)
        for depth, (at, ids) in enumerate(found, 1):
            e = free[at]
            piece[e], end[e] = ids, at + depth
            free[at] += 1
        return width, piece, end

    def _chances(self, left: np.ndarray, width: np.ndarray, piece: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each edge's chance given its node: its weight times the sum over all that may follow, as a share. last: the
        edges that end their chunk.

        Places of equal distance from their chunk's end are taken together, the last ones first. Sums are kept as
        logarithms, so that a chunk of any length keeps within range.
        """
        far = left.astype(np.uint16) if left.max() < 1 << 16 else left
        nodes = np.argsort(far, kind="stable")
        edges = np.argsort(np.repeat(far, width), kind="stable")
        after = np.zeros(len(left) + 1)
        weight, share = self.log_weight[piece[edges]], np.empty(len(edges))
        to = np.where(last, len(left), end)[edges]  # the place after all others has a sum of one
        count = np.bincount(left)[1:]
        wide, lo, e = width[nodes], 0, 0
        for n in count:
            w = wide[lo : lo + n]
            hi = e + int(w.sum())
            v = weight[e:hi] + after[to[e:hi]]
            starts = np.cumsum(w) - w
            top = np.maximum.reduceat(v, starts)
            v = np.exp(v - np.repeat(top, w))
            total = np.add.reduceat(v, starts)
            after[nodes[lo : lo + n]] = top + np.log(total)
            share[e:hi] = v / np.repeat(total, w)
            lo, e = lo + n, hi
        out = np.empty(len(edges))
        out[edges] = share
        return out

    def learn(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The first node of each chunk of each text. All new chunks are compiled together, in arrays."""
        if self.nodes > KEEP:
            self._reset()
        ends = np.cumsum([0, *map(len, texts)])
        found = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, ends[-1])
        missing, self.known.new = self.known.new, []
        if missing:
            try:
                self._compile(missing)
            except BaseException:
                self._reset()
                raise
        nodes = self.start[found]
        return [nodes[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def _compile(self, missing: list[str]) -> None:
        """Nodes and edges of the chunks that have the highest numbers, in the numbers' order."""
        symbols, length = self._symbols(missing)
        ends = np.repeat(np.cumsum(length), length)
        left = ends - np.arange(len(symbols))
        width, piece, end = self._fits(symbols, left)
        last = end == np.repeat(ends, width)
        chance = self._chances(left, width, piece, end, last)
        lo = np.cumsum(width) - width
        run = np.cumsum(chance)
        run -= np.repeat(run[lo] - chance[lo], width)
        run[lo + width - 1] = 1.0
        nodes, edges = self.nodes + len(symbols), self.edges + len(end)
        self._grow(self.known.count, nodes + 1, edges)
        self.first[self.nodes : nodes] = lo + self.edges
        self.first[nodes] = edges
        to = np.where(last, -1, end + self.nodes)
        for name, values in (("cum", run), ("chance", chance), ("to", to), ("piece", piece)):
            getattr(self, name)[self.edges : edges] = values
        self.start[self.known.count - len(missing) : self.known.count] = self.nodes + np.cumsum(length) - length
        self.long += [c for c in missing if len(c) > KEPT_LENGTH]
        self.nodes, self.edges = nodes, edges

    def forget_long(self) -> None:
        for c in self.long:
            del self.known[c]
        self.long.clear()

    def _grow(self, chunks: int, nodes: int, edges: int) -> None:
        """Room for so many of each. Room not yet used is not written to, so that it takes no memory."""
        for n, names in ((chunks, ("start",)), (nodes, ("first",)), (edges, ("cum", "chance", "to", "piece"))):
            for name in names:
                old = getattr(self, name)
                if n > len(old):
                    new = np.empty(2 * n, old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its chunk's end by chance: the edges taken, chunk after chunk, and each chunk's number."""
        cum, to, first = self.cum, self.to, self.first
        who, at, step, own = np.arange(len(node)), node, 0, key
        turns, count = [], np.zeros(len(node), np.int64)
        while len(who):
            u = _uniform(own + np.uint64(step * 0xD1342543DE82EF95 & _ALL))
            e = first[at]
            low = np.flatnonzero(cum[e] <= u)
            if len(low):
                f, v = e[low], u[low]
                while True:
                    f += 1
                    more = cum[f] <= v
                    if not more.any():
                        e[low] = f
                        break
                    e[low[~more]] = f[~more]
                    low, f, v = low[more], f[more], v[more]
            turns.append((who, e))
            at = to[e]
            on = np.flatnonzero(at >= 0)
            step += 1
            if len(on) < len(who):
                count[who[at < 0]] = step
            who, at, own = who[on], at[on], own[on]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (who, e) in enumerate(turns):
            out[begin[who] + step] = e
        return out, count


def lattice(path: str) -> Lattice:
    if path not in _models:
        _models[path] = Lattice(path)
    return _models[path]


class _Path:
    """A segmentation: its edges, each one's chunk, the log chance before each, and by edge the set of segmentations that
    leave it there. Of each set `delay` is kept, the least exponential clock of its members as a logarithm (inf before
    the edge where it left another path): the set's perturbed value, below the path's own, falls as its delay grows."""

    __slots__ = ("edges", "owner", "logs", "before", "log_prob", "value", "delay", "taken")

    def __init__(self, edges: np.ndarray, owner: np.ndarray, logs: np.ndarray, value: float, from_: int, late: np.ndarray) -> None:
        self.edges, self.owner, self.logs, self.value = edges, owner, logs, value
        run = np.cumsum(logs)
        self.before = np.concatenate([[0.0], run[:-1]]) if len(run) else run
        self.log_prob = float(run[-1]) if len(run) else 0.0
        self.delay = np.full(len(edges), np.inf)
        self.delay[from_:] = late - self.before[from_:]
        self.taken: dict[int, list[int]] = {}

    def next(self) -> tuple[int, float]:
        """The edge where the best of what is left leaves this path, and its value."""
        if not len(self.delay):
            return 0, -np.inf
        t = int(self.delay.argmin())
        return t, -float(np.logaddexp(-self.value, self.delay[t]))


def _clock(x: np.ndarray) -> np.ndarray:
    """Exponential variables."""
    return -np.log(_uniform(x))


def _late(p: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithms of edges' chances, and of their clocks over what the other edges there have; the n-th clock's key is
    the n-th of key plus n."""
    rest = 1.0 - p
    rest[rest < 1e-15] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(p), np.log(_clock(key + np.arange(len(key), dtype=np.uint64)) / rest)


def _key(base: np.ndarray, x: np.ndarray) -> np.ndarray:
    return base ^ _mix(x.astype(np.uint64))


def sample_batch(lat: Lattice, texts: list[str], keys: np.ndarray, k: int, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, up to k distinct segmentations by falling perturbed value: (ids, log chance, perturbed value,
    inclusion score).

    Best first: the set of all segmentations has a Gumbel value; the path drawn in it inherits that value, and the sets
    that leave the path at each edge get values below it. The set of the highest value is split next in the same way.
    That is Gumbel top-k without listing the segmentations. The inclusion score is the chance to be above the (k+1)-th
    value. All noise comes from the row's key, so neither batches nor tasks change it.
    """
    nodes = lat.learn([_cut(t) for t in texts])
    base = _mix(keys ^ np.uint64(seed))
    paths: list[list[_Path]] = [[] for _ in texts]
    plans = [(i, np.arange(len(n)), n, None, 0) for i, n in enumerate(nodes)]  # text, chunks to draw, their nodes, prefix, first own edge
    out: list[list] = [[] for _ in texts]
    values = -np.log(-np.log(_uniform(base)))
    for turn in range(k + 1):
        if turn:
            values, left = [], []
            for i, found in enumerate(paths):
                best, v = None, -np.inf
                for p in found:
                    t, g = p.next()
                    if g > v:
                        best, at, v = p, t, g
                if best is None or len(found) < turn:
                    continue
                if turn == k:  # the value that the k found are above
                    for x, p in enumerate(found):
                        ids, lp, g, _ = out[i][x]
                        out[i][x] = (ids, lp, g, float(-np.expm1(-np.exp(min(50.0, lp - v)))))
                    continue
                values.append(v)
                left.append((i, best, at))
            if turn == k or not left:
                break
            who, edge = np.array([x[0] for x in left]), np.array([x[2] for x in left])
            draws = _uniform(_key(base[who], edge + turn * 1_000_003)), _clock(_key(base[who], edge + turn * 7_000_003))
            plans = [_split(lat, nodes[i], i, best, at, u, c) for (i, best, at), u, c in zip(left, *(d.tolist() for d in draws))]
        if not plans:
            continue
        lengths = [len(p[1]) for p in plans]
        node = np.concatenate([p[2] for p in plans])
        salt = base[[p[0] for p in plans]] + np.uint64(turn * 0x2545F4914F6CDD1D & _ALL)
        key = _mix(np.concatenate([p[1] for p in plans]).astype(np.uint64) + np.repeat(salt, lengths))
        edges, count = lat.walk(node, key)
        ends = np.concatenate([[0], np.cumsum(count)])
        cuts = ends[np.concatenate([[0], np.cumsum(lengths)])]
        noise = np.array([(int(base[p[0]]) ^ (turn + 1) * 0xA0761D6478BD642F & _ALL) + p[4] & _ALL for p in plans], np.uint64)
        logs, late = _late(lat.chance[edges], np.repeat(noise - cuts[:-1].astype(np.uint64), np.diff(cuts)))
        lo = 0
        for (i, which, _, prefix, first), n, v, x, y in zip(plans, lengths, values, cuts, cuts[1:]):
            own, log, owner = edges[x:y], logs[x:y], np.repeat(which, count[lo : lo + n])
            lo += n
            if prefix is not None:
                own, owner, log = (np.concatenate(z) for z in zip(prefix, (own, owner, log)))
            p = _Path(own, owner, log, float(v), first, late[x:y])
            paths[i].append(p)
            out[i].append((lat.piece[own], p.log_prob, p.value, 1.0))
    lat.forget_long()
    return out


def _split(lat: Lattice, nodes: np.ndarray, i: int, path: _Path, t: int, u: float, clock: float):
    """The set that leaves path at edge t, split: an edge not yet taken there is drawn by u, and what is left of the set
    gets a value below this one by the clock."""
    e = int(path.edges[t])
    gone = path.taken.setdefault(t, [e])
    node = int(np.searchsorted(lat.first[: lat.nodes + 1], e, side="right")) - 1
    left = [x for x in range(int(lat.first[node]), int(lat.first[node + 1])) if x not in gone]
    p = lat.chance[left]
    new = left[min(len(left) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), u, side="right")))]
    gone.append(new)
    rest = float(p.sum() - lat.chance[new])
    if len(left) > 1 and rest > 0:
        path.delay[t] = np.logaddexp(path.delay[t], np.log(clock / rest) - path.before[t])
    else:
        path.delay[t] = np.inf
    o = int(path.owner[t])
    prefix = np.append(path.edges[:t], new), np.append(path.owner[:t], o), np.append(path.logs[:t], np.log(lat.chance[new]))
    which, at = np.arange(o + 1, len(nodes)), nodes[o + 1 :]
    if lat.to[new] >= 0:
        which, at = np.concatenate([[o], which]), np.concatenate([[lat.to[new]], at])
    return i, which, at, prefix, t + 1


def sample(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Up to k rows a document: (doc_id, sample, n_pieces, ids_crc32, log_prob, perturbed, inclusion[, ids]).

    Samples are distinct and numbered by falling perturbed value; a text of fewer segmentations gives all of them, with
    an inclusion score of 1. Null and empty texts have one segmentation, without pieces. Repeated rows give the same
    samples each; a null doc_id counts as key 0.
    """
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(ids):
                part, size = [], 0
                while lo + len(part) < len(ids) and (not part or size < TOGETHER):
                    t = texts[lo + len(part)].as_py() or ""
                    part.append(t)
                    size += len(t)
                keys = np.array([(d or 0) & 0xFFFFFFFFFFFFFFFF for d in ids[lo : lo + len(part)]], np.uint64)
                rows = {n: [] for n in ("doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "ids")}
                for d, found in zip(ids[lo : lo + len(part)], sample_batch(lat, part, keys, k, seed)):
                    for s, (pieces, lp, g, q) in enumerate(found, 1):
                        for n, v in zip(rows, (d, s, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), lp, g, q, pieces if with_ids else None)):
                            rows[n].append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
                names = [*rows] if with_ids else [*rows][:-1]
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, kinds)], names)
                lo += len(part)

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidied(run), _SCHEMA + extra)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids) as (doc_id, text); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = lattice(model).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else sp.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
