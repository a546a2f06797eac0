"""Toxicity scores by weak supervision: voters, a generative model of them, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .shared import held_out, only, stored, tidied

BITS = 20
#: At most so many labelled documents are mined for voters and anchor the label model, and so many unlabelled ones join
#: them there and in training the classifier.
LABELLED, UNLABELLED = 20_000, 20_000
#: What a lexicon voter's word or stem must reach among the labelled documents; at most so many voters are kept.
SUPPORT, RATIO, SIGMA, VOTERS = 3, 15.0, 5.0, 600
CUT = 0.5
#: Rows of votes that are taken as floating-point numbers at once, and terms sent on at once.
BLOCK, TERMS = 1024, 200_000
#: Patterns whose voters do not depend on any lexicon.
PATTERNS = (
    ("shouting", rb"(?:\b[A-Z]{4,}\b[ ,]+){3}"),
    ("anger", rb"[!?]{3,}"),
    ("you_are", rb"(?i:\byou(?:'re| are) (?:a |an |such )?[a-z]+)"),
    ("threat", rb"(?i:\b(?:hate|kill|hurt) (?:you|them|him|her)\b)"),
    ("masked", rb"[A-Za-z][*@#]{2,}[A-Za-z]"),
)
_PATTERNS = [(n, re.compile(p)) for n, p in PATTERNS]
_WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Lower-cased words and their stems (first 4, 5 and 6 letters, marked by a star) of white-space-bounded chunks."""

    def __init__(self, keep: int = 300_000) -> None:
        self.keep, self.known = keep, {}

    def of(self, text: bytes) -> set[str]:
        chunks, known = set(text.split()), self.known
        missing = chunks.difference(known)
        if missing:
            if len(known) + len(missing) > self.keep:
                known.clear()
                missing = chunks
            for c in missing:
                words = _WORD.findall(c.decode(errors="replace").lower())
                known[c] = tuple({t for w in words for t in (w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n))})
        return set().union(*map(known.__getitem__, chunks))


class Hashed:
    """Hashed features of a text, rising: each term counts once, however often or in however long a text it comes. With
    `among`, other features are left out, which at scoring are all those of weight zero. Those of known chunks are kept as
    the bytes of 32-bit integers."""

    def __init__(self, keep: int = 300_000, among: dict[int, float] | None = None) -> None:
        self.keep, self.known, self.terms, self.among = keep, {}, Terms(1), among

    def of(self, text: bytes) -> np.ndarray:
        chunks, known = set(text.split()), self.known
        missing = chunks.difference(known)
        if missing:
            if len(known) + len(missing) > self.keep:
                known.clear()
                missing = chunks
            for c in missing:
                found = (xxhash.xxh64_intdigest(t) & ((1 << BITS) - 1) for t in self.terms.of(c))
                known[c] = array("i", found if self.among is None else filter(self.among.__contains__, found)).tobytes()
        return np.unique(np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32))


@dataclass(frozen=True)
class LabelModel:
    """A voter says toxic or abstains. hit and miss: its chance to speak on toxic and on other texts; share: of the
    voters that speak together with it, how much of its evidence is its own (1 for one that depends on none)."""

    voters: list[str]
    prior: float
    hit: np.ndarray
    miss: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        said = (np.log(self.hit) - np.log(self.miss)) * self.share
        silent = (np.log1p(-self.hit) - np.log1p(-self.miss)) * self.share
        z = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for at, part in _blocks(votes):
            z[at] += part @ said + (1 - part) @ silent
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _blocks(votes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """All rows, BLOCK at a time, as double-precision numbers, so that no such copy of the whole is ever held."""
    for lo in range(0, len(votes), BLOCK):
        yield slice(lo, lo + BLOCK), votes[lo : lo + BLOCK].astype(float)


def fit_label_model(votes: np.ndarray, voters: list[str], known: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over votes (documents x voters). known: a label, or nan; a label anchors its posterior.

    Correlations are estimated with the accuracies, in the maximisation steps: given the posteriors, the residuals'
    correlations between voters, and from them the share of each voter's evidence that is its own (it is divided by one
    plus the sum of their squares), so that echoes of one source count about once in the next expectation.
    """
    n, m = votes.shape
    has = ~np.isnan(known)
    q = np.where(has, np.nan_to_num(known), prior)
    share = np.ones(m)
    for turn in range(rounds):
        w1, w0 = q.sum(), (1 - q).sum()
        spoke = np.zeros((2, m))
        for at, part in _blocks(votes):
            spoke += np.stack([q[at], 1 - q[at]]) @ part
        hit = np.clip((spoke[0] + 0.5) / (w1 + 1), 1e-4, 1 - 1e-4)
        miss = np.clip((spoke[1] + 0.05) / (w0 + 1), 1e-6, 1 - 1e-4)
        if turn % 3 == 2 and n > 2:
            products, total = np.zeros((m, m)), np.zeros(m)
            for at, rest in _blocks(votes):
                rest -= np.outer(q[at], hit)
                rest -= np.outer(1 - q[at], miss)
                products += rest.T @ rest
                total += rest.sum(0)
            cov = products / n - np.outer(total, total) / n**2
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + (corr**2).sum(0))
        model = LabelModel(voters, float(np.clip(w1 / max(1, n), 1e-4, 1 - 1e-4)), hit, miss, share)
        new = np.where(has, np.nan_to_num(known), model.posterior(votes))
        if np.abs(new - q).max(initial=0) < 1e-6 and turn > 10:
            break
        q = new
    return model


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen with `text`: each doc_id's, the least where it comes in several rows, so that copies of a row count once."""
    names = chosen.columns
    return docs.join(F.broadcast(chosen), "doc_id").groupBy(*names).agg(F.min("text").alias("text"))  # a bounded number of ids


def mine_voters(docs: DataFrame, chosen: DataFrame) -> tuple[list[str], float]:
    """Words and stems that speak for the label: those in SUPPORT toxic documents or more, at least RATIO times as
    likely in toxic ones after smoothing, and SIGMA deviations beyond chance. At most VOTERS, the strongest first. Also
    the labelled rows' toxic share."""

    def made(toxic: list[int], term: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(term, pa.string())], ["toxic", "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, toxic, term = Terms(), [], []
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms.of(t.as_py() or b"")
                toxic += [int(y > 0)] * len(found)
                term += found
                if len(term) > TERMS:
                    yield made(toxic, term)
                    toxic, term = [], []
        yield made(toxic, term)

    total = chosen.agg(F.count("*"), F.sum("y")).first()
    n, n1 = total[0], float(total[1] or 0)
    if not n1 or n1 == n:
        return [], 0.5 if not n else n1 / n
    rows = _texts(docs, chosen.select("doc_id", "y")).select("y", "text")
    counted = rows.mapInArrow(tidied(run), "toxic int, term string").groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    ratio = ((F.col("a") + 0.5) / F.lit(n1 + 1)) / ((F.col("n") - F.col("a") + 0.5) / F.lit(n - n1 + 1))
    share = n1 / n
    beyond = (F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counted.where((F.col("a") >= SUPPORT) & (ratio >= RATIO) & (beyond >= SIGMA)).orderBy((F.log(ratio) * F.sqrt("a")).desc(), "term").limit(VOTERS)
    return [r.term for r in best.select("term").collect()], n1 / n


def learned(batches: Iterator[pa.RecordBatch], names: list[str], prior: float, params: ftrl.Ftrl) -> tuple[ftrl.Linear, LabelModel]:
    """The classifier and its label model from batches of (place, y, votes, at).

    Votes are kept as bytes and features where the batches have them, so a feature of a document takes 4 bytes here.
    """
    place, y, said, at = [], [], [], []
    for b in batches:
        place += b.column(0).to_pylist()
        y += b.column(1).to_pylist()
        for column, to in ((b.column(2), said), (b.column(3), at)):
            if len(column):
                to += np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
    order = sorted(range(len(place)), key=lambda i: (place[i], said[i].tolist()))
    votes = np.zeros((len(order), len(names)), np.uint8)
    for r, i in enumerate(order):
        votes[r, said[i]] = 1
    known = np.array([np.nan if y[i] is None else y[i] for i in order], float)
    model = fit_label_model(votes, names, known, prior)
    return ftrl.Linear(ftrl.fit(_Rows([at[i] for i in order], model.posterior(votes)), 1 << BITS, params)), model


class _Rows:
    """(features, values, label) of each row, as often as asked for; every value is one and the ones are shared."""

    def __init__(self, at: list[np.ndarray], label: np.ndarray) -> None:
        self.at, self.label, self.ones = at, label, np.ones(max(map(len, at), default=0))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for at, y in zip(self.at, self.label):
            yield at, self.ones[: len(at)], y


def train(docs: DataFrame, labels: DataFrame, params: ftrl.Ftrl = ftrl.Ftrl(alpha=1.0, l1=3.0, l2=0.01, epochs=5)) -> tuple[ftrl.Linear, LabelModel]:
    """The classifier and its label model, from docs (doc_id, text binary) and labels (doc_id, toxic).

    Nothing of the held-out fold takes part. The label model sees the chosen labelled documents and UNLABELLED others
    outside that fold, those with the least hash of the id; labels anchor it. The classifier learns the model's
    posteriors of all of them, the labelled ones too.
    """
    chosen = stored(ftrl.sample(labels, "toxic", LABELLED), "toxic-labels")
    voters, prior = mine_voters(docs, chosen)
    words = {v: i for i, v in enumerate(voters)}
    names = [*voters, *(n for n, _ in _PATTERNS)]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, hashed = Terms(), Hashed()
        for b in batches:
            said, at = [], []
            for t in b.column(2):
                text = t.as_py() or b""
                own = sorted(words[w] for w in terms.of(text) & words.keys())
                said.append(own + [len(words) + i for i, (_, p) in enumerate(_PATTERNS) if p.search(text)])
                at.append(hashed.of(text))
            ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            found = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *at])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.list_(pa.int32())), found], ["place", "y", "votes", "at"])

    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    others = ids.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")  # LABELLED ids
    others = others.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(UNLABELLED)
    some = stored(chosen.select("doc_id", "place", "y").unionAll(others.select("doc_id", "place", F.lit(None).cast("double"))), "toxic-sample")
    voted = _texts(docs, some).select("place", "y", "text").mapInArrow(tidied(vote), "place long, y double, votes array<int>, at array<int>")
    voted = stored(voted, "toxic-votes")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, model = learned(batches, names, prior, params)
        out = np.concatenate([[model.prior], model.hit, model.miss, model.share])
        yield pa.RecordBatch.from_arrays([pa.array([linear.weights.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["w", "m"])

    found = voted.repartition(1).mapInArrow(tidied(learn), "w binary, m binary").collect()  # at most LABELLED + UNLABELLED rows
    if not found:
        none = np.zeros(len(names)) + 0.5
        return ftrl.Linear(np.zeros((1 << BITS) + 1, np.float32)), LabelModel(names, prior, none, none, none)
    m, k = np.frombuffer(bytes(found[0].m)), len(names)
    return ftrl.Linear(np.frombuffer(bytes(found[0].w), np.float32)), LabelModel(names, float(m[0]), m[1 : k + 1], m[k + 1 : 2 * k + 1], m[2 * k + 1 :])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for docs (doc_id, text) and labels (doc_id, toxic).

    Empty and null texts get the bias's score; repeated rows each return; a null doc_id is not held out. Without labels
    of both kinds no lexicon voter is found and the patterns alone speak.
    """
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    linear, _ = train(slim, labels)
    at = np.flatnonzero(linear.weights)
    sparse = {int(i): float(w) for i, w in zip(at, linear.weights[at])}
    bias = sparse.pop(1 << BITS, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, own = Hashed(500_000, sparse), sparse
        for b in batches:
            out = []
            for t in b.column(1):
                z = bias + sum(sorted(map(own.__getitem__, hashed.of(t.as_py() or b"").tolist())))
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    found = slim.mapInArrow(tidied(run), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
