"""SimHash fingerprints of word shingles, linked within a few bits by a pigeonring search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import only, stored, tidied

SEED = 42
BLOCK = 1 << 16
#: Segments of the ring: first bit and width. Three segments for two differing bits.
RING = ((0, 21), (21, 21), (42, 22))
TAU = 2


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 (seed 42); 0 where there is no word.

    bytes.lower() and bytes.split() touch A-Z and the six ASCII white-space characters alone, which is what is asked for.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = max(1, len(parts) - words + 1)
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[min(words, len(parts)) - 1 :]
    for lo in range(0, n, BLOCK):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[lo : lo + BLOCK], last[lo : lo + BLOCK])], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, hashed: bool = False) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text); a null text counts as empty. Rows never leave their task.

    hashed adds th, the text's SHA-256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8")), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    if hashed:
        return source.withColumn("th", _text_hash(F.col("text"))).mapInArrow(tidied(run), "doc_id long, fp long, th string")
    return source.mapInArrow(tidied(run), "doc_id long, fp long")


def _text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _segment(fp: Column, i: int) -> Column:
    lo, width = RING[i % 3]
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """Six keys: an equal segment, and one of the next segment's halves equal.

    If the segments' differences sum to 2 at most, some chain of the ring starts with 0 and stays at 1 at most over two
    segments (floors of 1 x 2/3 and 2 x 2/3). With one difference at most in the second segment, one of its halves is
    equal. So every pair shares a key of about 32 bits.
    """
    out = []
    for i in range(3):
        width = RING[(i + 1) % 3][1]
        low = width // 2
        head, nxt = _segment(fp, i), _segment(fp, i + 1)
        halves = (nxt.bitwiseAND(F.lit((1 << low) - 1)), F.shiftrightunsigned(nxt, low))
        for k, half in enumerate(halves):
            out.append(F.lit((i * 2 + k) << 40) + F.shiftleft(head, 12) + half)
    return F.array(*out)


def _chain(x: Column) -> Column:
    """Some start of the ring keeps within its budgets: 0, then 1, then 2 differing bits."""
    d = [F.bit_count(_segment(x, i)) for i in range(3)]
    starts = [(d[i] == 0) & (d[i] + d[(i + 1) % 3] <= 1) for i in range(3)]
    return (starts[0] | starts[1] | starts[2]) & (F.bit_count(x) <= TAU)


def fingerprint_links(classes: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (a, b) that join classes (fp, rep) into the same groups as all pairs within two bits would.

    Buckets of up to `bucket` fingerprints are compared pair by pair under the chain test. Larger ones are not: two
    fingerprints are within two bits exactly if some value is within one bit of both, so each member is filed under its
    65 such values and linked to the least member there. A value has 65 members at most, all within two bits of each
    other: the work is linear and no link is lost.
    """
    filed = stored(classes.select("fp", "rep", F.explode(_keys(F.col("fp"))).alias("k")), "ring")
    sizes = filed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    sized = filed.join(sizes, "k")
    small = sized.where(F.col("n") <= bucket).select("k", "fp", "rep")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    pairs = (
        small.alias("l")
        .join(small.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.rep") < F.col("r.rep")) & _chain(x))
        .select(F.col("r.rep").alias("a"), F.col("l.rep").alias("b"))
    )
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(np.array(1 << i, "u8").astype("i8").item())) for i in range(64)])
    large = sized.where(F.col("n") > bucket).select("fp", "rep").distinct().select("rep", F.explode(near).alias("mid"))
    least = large.groupBy("mid").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = large.join(least, "mid").where("rep != b").select(F.col("rep").alias("a"), "b")
    return pairs.unionAll(stars)


def _components(fps: DataFrame, bucket: int) -> DataFrame:
    """(fp, component_id) of every fingerprint of fps (doc_id, fp) that a numbered row has."""
    classes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(fingerprint_links(classes, bucket))
    return classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, bucket: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and cut into shingles of `words` words; documents whose fingerprints differ in two bits
    or fewer are linked, and component_id is the least doc_id reachable. Null texts are empty texts; a text without
    words has fingerprint zero and links like any other. Repeated rows each return. A row with a null doc_id gets its
    fingerprint's component, null if no numbered row shares it. Copies are one class: they never become pairs.
    """
    fps = stored(fingerprints(only(docs, "doc_id", "text"), words), "fingerprints")
    return fps.join(_components(fps, bucket), "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Words of a shingle, least similarity, and the sketch: bands of min-wise hashes that find pairs beyond two bits.
STAGE_WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 5
#: Pairs of texts in an Arrow batch.
PAIRS = 500


def shingle_set(text: bytes | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending; case and white space as in fingerprint()."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(n)], np.uint64))


def _bands(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n) of every text with a word: ROWS min-wise hashes under each of BANDS keys, and its shingles' number."""
    rng = np.random.default_rng(SEED)
    mult = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sizes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingle_set(t.as_py())
                if len(h):
                    low = np.full(BANDS * ROWS, ~np.uint64(0))
                    for lo in range(0, len(h), 4096):
                        x = h[lo : lo + 4096, None] * mult + add
                        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(0))
                    ids += [i] * BANDS
                    sizes += [len(h)] * BANDS
                    keys += [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())], ["doc_id", "k", "n"])

    return docs.mapInArrow(tidied(run), "doc_id long, k long, n long")


def _similar(pairs: DataFrame) -> DataFrame:
    """(a, b): the roots ra and rb of those pairs (a, b, ra, rb, ta, tb) whose shingle sets are SIMILAR or more by Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], {}
            for r, ends in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for side, i in enumerate(ends):
                    if i not in sets:
                        sets[i] = shingle_set(batch.column(4 + side)[r].as_py())
                x, y = sets[ends[0]], sets[ends[1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILAR * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at)], ["a", "b"])

    return pairs.mapInArrow(tidied(run), "a long, b long")


def _with_texts(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    texts = reps.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    other = reps.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(texts, "a").join(other, "b").select("a", "b", "ra", "rb", "ta", "tb")


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The links of those pairs that hold, stored. A row brings two whole texts, so Arrow batches are kept short meanwhile."""
    conf, name = reps.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(PAIRS))
    try:
        return stored(_similar(_with_texts(pairs, reps)), "similar")
    finally:
        conf.set(name, before)


def _grouped(keys: DataFrame, links: DataFrame) -> DataFrame:
    """keys with `c`, the component that links (a, b) of roots give each root."""
    found = connected_components(links).select(F.col("node").alias("root"), F.col("component").alias("c"))
    return keys.join(found, "root", "left").withColumn("c", F.coalesce("c", "root"))


def _shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n) of every distinct shingle of docs (doc_id, text binary), n being the text's number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                h = shingle_set(t.as_py())
                for lo in range(0, len(h), BLOCK):
                    part = h[lo : lo + BLOCK].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(part), pa.int64()), pa.array(part), pa.array(np.full(len(part), len(h), np.int64))], ["doc_id", "h", "n"])

    return docs.mapInArrow(tidied(run), "doc_id long, h long, n long")


def _rarest(shingles: DataFrame) -> DataFrame:
    """(doc_id, k, i, n): of each text's n shingles, rarest first, those that a partner at SIMILAR cannot all lack.

    A partner holds SIMILAR x n of them at least, so it holds one of the first n - SIMILAR x n + 1 whatever the order.
    Shingles of one text alone come first and are left out, as nothing can share them; i is the place among all.
    """
    often = shingles.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1")
    text = Window.partitionBy("doc_id")
    place = F.col("n") - F.count("*").over(text) + F.row_number().over(text.orderBy("texts", "h"))
    placed = shingles.join(often, "h").select("doc_id", F.col("h").alias("k"), place.alias("i"), "n")
    return placed.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1)


def _across(keys: DataFrame, block: int) -> DataFrame:
    """(a, b, ra, rb), a > b: the pairs of keys (doc_id, k, i, n, root, c) of one k whose c differ and that may be SIMILAR.

    The first shingle that a pair shares bounds what it can share in all by what follows it in either text, so a pair
    whose every common key falls short of SIMILAR is none. A key's members are cut into parts of about `block`, and two
    parts meet under a key of their own, so that no task has more than block x block pairs of a key to look at.
    """
    mixed = keys.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    open_ = keys.join(mixed.where("lo < hi").select("k", "parts"), "k").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    cols = ["k", "doc_id", "root", "i", "n", "c"]
    left = open_.select(*cols, F.col("g").alias("x"), F.explode(F.sequence("g", F.col("parts") - 1)).alias("y"))
    right = open_.select(*cols, F.explode(F.sequence(F.lit(0), "g")).alias("x"), F.col("g").alias("y"))
    l, r = left.alias("l"), right.alias("r")
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    once = (F.col("l.x") < F.col("l.y")) | (F.col("l.doc_id") < F.col("r.doc_id"))
    most = F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i")) + 1
    fits = most * (1 + SIMILAR) >= (F.col("l.n") + F.col("r.n")) * SIMILAR - 1e-9
    pairs = l.join(r, same & once & (F.col("l.c") != F.col("r.c")) & fits)
    turned = F.col("l.doc_id") < F.col("r.doc_id")
    pick = lambda x, y, name: F.when(turned, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(pick("r.doc_id", "l.doc_id", "a"), pick("l.doc_id", "r.doc_id", "b"), pick("r.root", "l.root", "ra"), pick("l.root", "r.root", "rb")).distinct()


def similar_links(reps: DataFrame, roots: DataFrame | None = None, turns: int = 2, block: int = 1024) -> DataFrame:
    """Edges (a, b) that join texts of reps (doc_id, text binary) into the same groups as all candidate pairs would.

    Texts that share a band key are candidates; an edge needs SIMILAR of the five-word shingles. First every member of
    a bucket is compared with the least one, then what this did not group with it among itself in the same way; so a
    bucket of copies costs a comparison a member. Texts of buckets that still hold two groups or more are then joined
    on their rarest shingles, which finds every pair of them at SIMILAR; texts that a crowd merely resembles have
    shingles of their own in that place and meet nobody.
    roots (doc_id, root) names groups that hold already: their texts all take part, but are not compared with each
    other, and edges join roots. Without it a text is its own root.
    """
    bands = _bands(reps)
    keys = stored(bands.withColumn("root", F.col("doc_id")) if roots is None else bands.join(roots, "doc_id"), "bands")
    left, seen, found = keys, None, None
    for turn in range(turns):
        least = left.groupBy("k").agg(F.min("doc_id").alias("b"), F.min_by("root", "doc_id").alias("rb"), F.count("*").alias("m")).where("m > 1")
        pairs = left.join(least, "k").where("root != rb").select(F.col("doc_id").alias("a"), "b", F.col("root").alias("ra"), "rb")
        pairs = stored(pairs.distinct(), "led")
        fresh = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        linked = _verified(fresh, reps)
        seen, found = (pairs, linked) if seen is None else (seen.unionAll(pairs), found.unionAll(linked))
        if turn + 1 < turns:
            named = stored(_grouped(left, found), "grouped")
            leads = named.groupBy("k").agg(F.min_by("c", "doc_id").alias("lead"))
            left = stored(named.join(leads, "k").where("c != lead").select(*keys.columns), "bands")
    named = stored(_grouped(keys, found), "grouped")
    mixed = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    open_ = stored(named.join(mixed, "k").select("doc_id", "root", "c").distinct(), "open")
    shingles = stored(_shingles(reps.join(open_.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")), "shingles")
    rest = _across(stored(_rarest(shingles).join(open_, "doc_id"), "rarest"), block).join(seen, ["a", "b"], "left_anti")
    return found.unionAll(_verified(rest, reps))


def deduplicate(docs: DataFrame, bucket: int = 64) -> DataFrame:
    """docs with one document of each group: the one of the least doc_id, its columns as they are.

    Documents group if their fingerprints are within two bits (as near_duplicates has it), or their texts share 0.8 of
    their five-word shingles; every distinct text takes part in both searches. Texts without words are one group. Rows
    with a null doc_id stay. A repeated doc_id counts and stays once, with the text of the least SHA-256.
    """
    fps = fingerprints(only(docs.where("doc_id is not null"), "doc_id", "text"), hashed=True)
    one = fps.groupBy("doc_id").agg(F.min(F.struct("th", "fp")).alias("m")).select("doc_id", "m.th", "m.fp")
    texts = stored(one.groupBy("th", "fp").agg(F.min("doc_id").alias("doc_id")), "texts")
    roots = stored(texts.join(_components(texts, bucket), "fp").select("doc_id", F.col("component_id").alias("root")), "roots")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    reps = source.withColumn("th", _text_hash(F.col("text"))).join(texts.select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    reps = stored(reps.groupBy("doc_id").agg(F.min("text").alias("text")), "reps")
    more = connected_components(similar_links(reps, roots)).where("node != component").select(F.col("node").alias("doc_id"))
    kept = roots.where("doc_id = root").join(more, "doc_id", "left_anti").select(F.col("doc_id").alias("__kept"))
    rows = docs.join(kept, F.col("doc_id") == F.col("__kept")).drop("__kept")
    first = Window.partitionBy("doc_id").orderBy(_text_hash(F.col("text")))
    rows = rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    return rows.unionByName(docs.where("doc_id is null"))
