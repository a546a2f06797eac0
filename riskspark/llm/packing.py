"""Best-fit-decreasing packing of token pieces, certified by dual-feasible bounds and repaired by exchange."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, stored, tidied

CAPACITY = 4096
PART = 4096
ROUNDS = 2
END = np.array([1], "<u4").tobytes()
LOT = 4_000_000
#: Latin letters without the dotted I, and Cyrillic ones: all of them are whole in NFC and fold to one letter.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u047f]+")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Kinds of bytes. A letter of two bytes is known by its first one, INNER; other bytes and digits are OTHER.
SPACE, LETTER, MARK, APOSTROPHE, INNER, OTHER = range(6)
_KIND = np.array([SPACE if c in b"\t\n\v\f\r " else APOSTROPHE if c == 39 else MARK if c in _MARKS else LETTER if c < 128 and chr(c).isalpha() else INNER if c in b"\xc3\xc4\xc5\xd0\xd1" else OTHER for c in range(256)], np.uint8)
#: By 6 times the kind of a byte and that of the next: whether a chunk begins with the next, and whether one ends before it.
_CUT = np.array([(a, b) == (MARK, LETTER) or (a, b) == (MARK, INNER) or a == LETTER and b in (MARK, APOSTROPHE) for a in range(6) for b in range(6)])
_BEGIN = _CUT | np.array([a == SPACE != b for a in range(6) for b in range(6)])
_END = _CUT | np.array([a != SPACE == b for a in range(6) for b in range(6)])
_tokenizers: dict = {}


class Encoder:
    """Ids of texts as little-endian bytes, put together from their chunks.

    The vocabulary's pre-tokenizer never joins across ASCII white space, nor a letter and an ASCII mark after it, nor such
    a mark and a letter after it, but for the apostrophe, which may begin a word's ending; and it folds case. So the ids of
    the chunks between, lower-cased, stand for those of the text. Each chunk is looked up once for a lot of texts; chunks
    are kept for reuse in two generations, up to a bound. Texts that may hold a special token's string (found before case
    is folded) go to the tokenizer whole; those with combining marks, which NFC joins to some small letters only, keep
    their case.
    """

    def __init__(self, path: str, keep: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.keep, self.known, self.old = Tokenizer.from_file(path), keep, {}, {}
        self.words, suffix = Tokenizer(self.model.model), self.model.model.end_of_word_suffix
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are cut and folded already: the merges alone, many words at once, told apart by the tokens
        that end a word."""
        ids = np.array(self.words.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        raw = ids.tobytes()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Letters alone and marks alone are words as they are, other chunks go through the whole tokenizer."""
        known, whole, words, folded = self.known, [], [], {}
        for c in chunks:
            if c.isalpha():  # ASCII letters
                word = c.lower()
            elif c.isascii():
                word = b"" if c.strip(_MARKS) else c
            else:
                text = c.decode()
                word = text.lower().encode() if _LETTERS.fullmatch(text) else b""
            if not word:
                whole.append(c)
            elif word == c:
                words.append(c)
            else:
                folded[c] = word
        words += {w for w in folded.values() if w not in known}.difference(words)
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            known.update(zip(part, self._words(part)))
        known.update([(c, known[word]) for c, word in folded.items()])
        for lo in range(0, len(whole), 20_000):
            part = whole[lo : lo + 20_000]
            found = self.model.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, found))

    def _look(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of the chunks, which are distinct."""
        if len(self.known) > self.keep // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = list(map(known.get, chunks))
        missing = [c for c, ids in zip(chunks, found) if ids is None]
        if missing:
            known.update([(c, ids) for c, ids in zip(missing, map(old.get, missing)) if ids is not None])
            self._learn([c for c in missing if c not in known])
            found = [known[c] if ids is None else ids for c, ids in zip(chunks, found)]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        plain = [b"" if b"<|" in t else t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        raw = np.frombuffer(b" ".join([b"", *plain, b""]), np.uint8)
        kind = _KIND[raw]
        inner = np.flatnonzero(kind == INNER)
        first, second = raw[inner], raw[inner + 1]
        sign = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0)  # no letters, dotted I
        kind[inner[sign]], kind[inner[~sign] + 1] = OTHER, LETTER
        pairs = kind[:-1] * np.uint8(6) + kind[1:]
        starts = np.flatnonzero(_BEGIN[pairs]) + 1
        if not len(starts):
            ids, ends = pa.py_buffer(b""), [0] * (len(texts) + 1)
        else:
            at = np.concatenate([[0], np.cumsum(np.flatnonzero(_END[pairs]) + 1 - starts)])
            chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[kind != SPACE])]).dictionary_encode()
            known = pa.array(self._look(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            _, at, ids = known.take(chunks.indices).buffers()
            ends = np.frombuffer(at, np.int64)[np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in plain)]))].tolist()
        return [np.array(self.model.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() if b"<|" in t else ids[lo:hi].to_pybytes() for t, lo, hi in zip(texts, ends, ends[1:])]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def _encoded(coder: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text and the id 1; texts are encoded in lots of about LOT bytes."""
    lot, held = [], 0
    for t in texts:
        lot.append(t.as_py() or b"")
        held += len(lot[-1])
        if held >= LOT:
            yield from (ids + END for ids in coder.encode(lot))
            lot, held = [], 0
    yield from (ids + END for ids in coder.encode(lot))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of docs (doc_id, text): whole documents, longer ones cut. salt is
    the row's place in its task, which tells repeated rows apart."""
    width = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), 0
        for batch in batches:
            doc, piece, start, length, crc, salt = [], [], [], [], [], []
            for i, ids in zip(batch.column(0).to_pylist(), _encoded(coder, batch.column(1))):
                row += 1
                for k, lo in enumerate(range(0, len(ids), width)):
                    cut = ids[lo : lo + width]
                    doc.append(i), piece.append(k), start.append(lo // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut)), salt.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary"))
    return source.mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual-feasible bounds on the bins that sizes need: volume, thresholds, rounding."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    tail_n, tail_s = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    half = capacity // 2
    for a in range(1, half + 1):  # sizes over capacity - a count whole, those under a nothing
        over = int(tail_n[capacity - a + 1])
        large, large_s = int(tail_n[half + 1]) - over, int(tail_s[half + 1] - tail_s[capacity - a + 1])
        small_s = int(tail_s[a] - tail_s[half + 1])
        best = max(best, over + large + max(0, -(-(small_s - (large * capacity - large_s)) // capacity)))
    for k in range(1, 41):  # x counts as floor((k+1)x)/k, or as itself where (k+1)x is whole
        up = size * (k + 1)
        whole = up % capacity == 0
        scaled = np.where(whole, size * k, (up // capacity) * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. `free` has a bit for each gap that some open bin has."""
    place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: dict[int, list[int]] = {}
    free = bins = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fit = free >> s
        if fit:
            gap = s + (fit & -fit).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                free &= ~(1 << gap)
        else:
            gap, b, bins = capacity, bins, bins + 1
        place[i], offset[i] = b, capacity - gap
        if gap > s:
            open_bins.setdefault(gap - s, []).append(b)
            free |= 1 << (gap - s)
    return place, offset


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, loose boolean, bound long"


def _pack(items: DataFrame, rows: int, turn: int, capacity: int) -> DataFrame:
    parts = max(1, -(-rows // PART))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "salt"], ignore_index=True)
        sizes = pdf.length.to_numpy(np.int64)
        bound = lower_bound(sizes, capacity)
        place, offset = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(place, sizes).astype(np.int64)
        gap, over = capacity - fill, len(fill) - bound
        if over > 0:  # not certified: the bins with more than the usual gap go back
            loose = gap > max(1, gap[gap > 0].mean() if (gap > 0).any() else 0)
        else:  # certified; its emptiest bin may still fill up with others
            loose = (np.arange(len(gap)) == gap.argmax()) & (gap > 0)
        base = (turn << 60) + (int(pdf.part.iloc[0]) << 24)
        out = pdf.drop(columns="part")
        return out.assign(sequence_id=base + place, offset=offset, loose=loose[place], bound=np.int64(bound))

    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt", F.lit(turn)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, _PACKED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs (doc_id, text), in few full sequences.

    A document is its ids and the id 1; an empty or null text is that id alone. Pieces are dealt at random into parts of
    about 4096, each packed best-fit decreasing and compared with its dual-feasible lower bound. Parts that reach the
    bound are certified; the others give back their loose bins, and certified ones their emptiest bin. What came back is
    dealt anew and packed again, and a turn counts only if it takes fewer sequences. Repeated rows are packed each; a
    null doc_id is a document like any other.
    """
    cut = stored(pieces(only(docs, "doc_id", "text"), tokenizer, capacity), "pieces")
    held, todo, rows = None, cut, cut.count()
    names = [*[c for c in cut.columns if c != "salt"], "sequence_id", "offset"]
    for turn in range(ROUNDS + 1):
        done = stored(_pack(todo, rows, turn, capacity), "packed")
        if turn:
            new = done.select("sequence_id").distinct().count()
            if new >= bins:
                done, last = before, True
            else:
                last = turn == ROUNDS
        else:
            last = False
        if last:
            out = done.select(*names)
            return out if held is None else held.unionAll(out)
        kept = done.where(~F.col("loose")).select(*names)
        loose = done.where("loose")
        n = loose.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        rows, bins = n[0], n[1]
        if bins < 2:
            out = done.select(*names)
            return out if held is None else held.unionAll(out)
        held = kept if held is None else held.unionAll(kept)
        before, todo = loose, loose.select(*cut.columns)
    raise AssertionError("the last turn returns")
