"""Quality scores: hashed word n-grams under a logistic regression trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ftrl
from .shared import held_out, only, stored, tidied

BITS = 18
#: At most so many labelled rows are learnt from.
LABELLED = 20_000
CUT = 0.3
_MASK = np.uint64((1 << BITS) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shape(word: str) -> str:
    """Case, digits and other characters of a word, runs cut to two: 'Hello!!!' is 'Aaa!!'."""
    out: list[str] = []
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [c, c]:
            out.append(c)
    return "".join(out)


class Words:
    """Hashes of the lower-cased form and of the shape of each white-space-bounded word; kept for reuse, up to a bound."""

    def __init__(self, keep: int = 400_000) -> None:
        self.keep = keep
        self._reset()

    def _reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((2, 1024), np.uint64)

    def _learn(self, missing: set[bytes]) -> None:
        lo = len(self.place)
        if lo + len(missing) > self.table.shape[1]:
            grown = np.zeros((2, 2 * (lo + len(missing))), np.uint64)
            grown[:, :lo] = self.table[:, :lo]
            self.table = grown
        for i, w in enumerate(missing, lo):
            text = w.decode(errors="replace")
            self.place[w] = i
            self.table[0, i] = xxhash.xxh64_intdigest(text.lower())
            self.table[1, i] = xxhash.xxh64_intdigest(shape(text), 1)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        missing = set(words).difference(self.place)
        if missing:
            if len(self.place) + len(missing) > self.keep:
                self._reset()
                missing = set(words)
            self._learn(missing)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.table[0, at], self.table[1, at]


def features(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed uni- and bigrams of words and of shapes, and equal neighbours; each has the root of its share, so the
    vector has length one whatever the text's length."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    w, s = words.look_up(parts)
    same = np.full(int((w[1:] == w[:-1]).sum()), 11, np.uint64)
    all_ = np.concatenate([w, s, w[:-1] * _MIX[0] + (w[1:] >> np.uint64(7)), s[:-1] * _MIX[1] + (s[1:] >> np.uint64(5)), same])
    count = np.bincount(((all_ ^ (all_ >> np.uint64(32))) & _MASK).astype(np.int64)) if len(all_) > 1 << 16 else None
    if count is not None:
        at = np.flatnonzero(count)
        return at, np.sqrt(count[at] / len(all_))
    at, n = np.unique((all_ ^ (all_ >> np.uint64(32))) & _MASK, return_counts=True)
    return at.astype(np.int64), np.sqrt(n / len(all_))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, params: ftrl.Ftrl = ftrl.Ftrl(alpha=2.0, l1=0.01, epochs=3)) -> ftrl.Linear:
    """A model of labels (doc_id, quality) on at most `bound` documents outside the held-out fold. A doc_id that
    comes in several rows counts once, with its least text, so neither copies nor the rows' order change the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            found = [features(t.as_py() or b"", words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), b.column(1)], ["place", "at", "value", "y"])

    chosen = F.broadcast(stored(ftrl.sample(labels, "quality", bound), "quality-labels"))  # `bound` rows of three numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).join(chosen, "doc_id")
    made = rows.groupBy("doc_id", "place", "y").agg(F.min("text").alias("text")).select("place", "y", "text").mapInArrow(tidied(run), "place long, at array<int>, value array<float>, y double")
    return ftrl.train(made, 1 << BITS, params)


def score(docs: DataFrame, model: ftrl.Linear, name: str = "score") -> DataFrame:
    """docs with `name`, the likelihood of label 1, from the text alone; null texts count as empty. Columns stay; name is
    none of theirs."""
    names = [*docs.columns, name]
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, linear = Words(), ftrl.Linear(weights)
        for b in batches:
            found = [linear.score(*features(t.as_py() or b"", words)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.float64())], names)

    source = docs.select(F.col("text").cast("string").cast("binary").alias("__text"), *[F.col(f"`{c}`") for c in docs.columns])
    return source.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for docs (doc_id, text) and labels (doc_id, quality).

    Empty and null texts get the bias's score; repeated rows each return; a null doc_id is not held out. No labels give
    a score of 0.5.
    """
    docs = only(docs, "doc_id", "text")
    slim = docs.withColumn("text", F.col("text").cast("string"))
    model = train(docs, labels)
    found = scores_only(slim, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def scores_only(docs: DataFrame, model: ftrl.Linear) -> DataFrame:
    """(doc_id, score): as score(), but texts do not come back from Python."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, linear = Words(), ftrl.Linear(weights)
        for b in batches:
            found = [linear.score(*features(t.as_py() or b"", words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(tidied(run), "doc_id long, score double")
