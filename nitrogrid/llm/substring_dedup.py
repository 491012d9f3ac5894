"""Repeated passages of 20 words, found by recompression.

Words are the first symbols. A round names maximal runs of one symbol, then pairs: each symbol
belongs to the left or the right class, and every left symbol before a right one is joined with it.
A name is a hash of what it stands for, and the class a bit of the name, so all tasks name alike
and equal passages get equal symbols, save near their ends. Each symbol knows how far left and
right of it the words decide that it is there; where that range is inside a window, the symbol is
interior to the window, whatever stands around. After two rounds a window of 20 words without long
runs has interior symbols. Its anchor is the one with the smallest hash, its key the symbol with
the words that decide it; so windows with a common high-level symbol meet. A window without any has
its own hash as key.

Shared symbols only propose. Whole segments and, where those differ, single windows are then
compared by fingerprints of their words, in two independent 64-bit streams.

Defined cases: a null text has no words. A row without doc_id is left whole and takes no part. Rows
with one doc_id and start are at one place: none is earlier. What is removed is known by doc_id and
text, so rows that share a doc_id keep what only the other one repeats. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm import repeats
from nitrogrid.llm.common import mixed, stored
from nitrogrid.llm.repeats import Segments
from nitrogrid.llm.textarrays import BASE, range_hash, words

WINDOW = 20
ROUNDS = 2
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Symbols:
    """A row of symbols. The words from need_lo to before need_hi decide that a symbol is there."""
    name: np.ndarray
    need_lo: np.ndarray
    need_hi: np.ndarray
    doc: np.ndarray


def neighbours(s: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """need_lo of the symbol before each and need_hi of the one after; out of reach at a document's ends."""
    before, after = np.empty_like(s.need_lo), np.empty_like(s.need_hi)
    before[1:], after[:-1] = s.need_lo[:-1], s.need_hi[1:]
    starts = np.ones(len(s.doc), bool)
    starts[1:] = s.doc[1:] != s.doc[:-1]
    ends = np.ones(len(s.doc), bool)
    ends[:-1] = starts[1:]
    before[starts] = first[s.doc[starts]] - 1
    after[ends] = first[s.doc[ends] + 1] + 1
    return before, after


def runs_named(s: Symbols, first: np.ndarray, turn: int) -> Symbols:
    """Each maximal run of one symbol becomes a symbol."""
    before, after = neighbours(s, first)
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(s.name)))
    last = at + length - 1
    name = mixed(s.name[at] * BASE + length.astype(np.uint64) * _OTHER + np.uint64(2 * turn))
    return Symbols(name, before[at], after[last], s.doc[at])


def pairs_named(s: Symbols, first: np.ndarray, turn: int) -> Symbols:
    """Each left symbol before a right one is joined with it."""
    before, after = neighbours(s, first)
    left = (mixed(s.name + np.uint64(turn * int(_OTHER) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(left), bool)
    joins[:-1] = left[:-1] & ~left[1:] & (s.doc[1:] == s.doc[:-1])
    second = np.zeros(len(left), bool)
    second[1:] = joins[:-1]
    at = np.flatnonzero(~second)
    end = at + joins[at]
    alone = ~joins[at]
    pair = mixed(s.name[at] * BASE + s.name[end] * _OTHER + np.uint64(2 * turn + 1))
    name = np.where(alone, mixed(s.name[at] + np.uint64(2 * turn + 1)), pair)
    # a single left symbol depends on its next one, a single right symbol on the one before
    lo = np.where(alone & ~left[at], before[at], s.need_lo[at])
    hi = np.where(alone & left[at], after[at], s.need_hi[end])
    return Symbols(name, lo, hi, s.doc[at])


def compressed(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    count = np.diff(first)
    at = np.arange(len(hashes))
    s = Symbols(hashes, at, at + 1, np.repeat(np.arange(len(count)), count))
    for turn in range(1, rounds + 1):
        s = pairs_named(runs_named(s, first, turn), first, turn)
    return s


def smallest_between(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the smallest value in [lo, hi), the first of equal ones; all ranges have an entry."""
    size = hi - lo
    table = [np.arange(len(value))]
    while 2 << (len(table) - 1) <= size.max(initial=1):
        half = 1 << (len(table) - 1)
        a, b = table[-1][:-half], table[-1][half:]
        table.append(np.where(value[b] < value[a], b, a))
    level = np.frexp(size.astype(np.float64))[1] - 1
    found = np.empty(len(lo), np.int64)
    for k, row in enumerate(table):
        on = np.flatnonzero(level == k)
        a, b = row[lo[on]], row[hi[on] - (1 << k)]
        found[on] = np.where(value[b] < value[a], b, a)
    return found


def keyed_windows(column: pa.Array, width: int = WINDOW) -> Segments:
    """The segments of a text column: windows by their anchor symbol."""
    w = words(column)
    count = np.diff(w.first)
    windows = np.maximum(count - width + 1, 0)
    total = int(windows.sum())
    place = np.arange(total) + np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    if not total:
        none = np.zeros(0, np.int64)
        return Segments(none.view(np.uint64), none, none, w.first, w)
    s = compressed(w.hashes, w.first)
    value = mixed(s.name)
    lo = np.searchsorted(s.need_lo, place, side="left")
    hi = np.searchsorted(s.need_hi, place + width, side="right")
    has = hi > lo
    key = np.empty(total, np.uint64)
    anchor = np.empty(total, np.int64)
    at = smallest_between(value, lo[has], hi[has]) if has.any() else np.zeros(0, np.int64)
    # all words that decide the symbol are in the window: they make a key that seldom meets by chance
    key[has], anchor[has] = mixed(range_hash(w.hashes, s.need_lo[at], s.need_hi[at]) + value[at]), at
    bare = place[~has]
    key[~has], anchor[~has] = mixed(range_hash(w.hashes, bare, bare + width)), -1 - bare
    key, start, n = repeats.by_anchor(key, anchor, place)
    return Segments(key, start, n, w.first, w)


def fingerprint(s: Segments, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(range_hash(s.data.hashes, start, end)), mixed(range_hash(s.data.second, start, end))


def opened_windows(width: int):
    """Equal windows among open segments, one row per window."""

    def opened(rows: DataFrame, packed: np.ndarray, several: DataFrame) -> DataFrame:
        each = repeats.open_segments(rows, lambda c: keyed_windows(c, width), packed)

        def emit(batches):
            for s, on, ids, text_keys, place in each(batches):
                n = s.count[on]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(s.start[on], n) + step
                fa, fb = fingerprint(s, at, at + width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array(np.repeat(ids, n)),
                     pa.array(np.repeat(text_keys, n)), pa.array(np.repeat(place, n) + step)],
                    names=["fa", "fb", "doc_id", "text_key", "start"])

        windows = stored(rows.mapInArrow(emit, "fa long, fb long, doc_id long, text_key long, start long"), "repeat-windows")
        heads = windows.groupBy("fa", "fb").agg(F.min(F.struct("doc_id", "start")).alias("head"), F.count("*").alias("n")) \
            .where("n > 1").select("fa", "fb", "head")
        return (
            windows.join(heads, ["fa", "fb"])
            .where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("start") != F.col("head.start")))
            .select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))
        )

    return opened


def cut_words(batches):
    for batch in batches:
        w = words(batch.column("text"))
        raw = w.raw.tobytes()
        first = w.first.tolist()
        n_words, n_removed, digest = [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            a, size = first[i], first[i + 1] - first[i]
            kept, at, removed = [], 0, 0
            for lo, hi in repeats.merged([(r["lo"], r["hi"]) for r in ranges], size):
                kept += range(a + at, a + lo)
                removed += hi - lo
                at = hi
            kept += range(a + at, a + size)
            start, end = w.start[kept].tolist(), w.end[kept].tolist()
            digest.append(hashlib.sha256(b" ".join(raw[x:y] for x, y in zip(start, end, strict=True))).hexdigest())
            n_words.append(size)
            n_removed.append(removed)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, lo, hi): the ranges of words to remove; they may overlap."""
    return repeats.repeated_ranges(docs, lambda c: keyed_windows(c, width), fingerprint, width, opened_windows(width))


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    return repeats.cut_texts(docs, repeated_words(docs, width), cut_words,
                             "doc_id long, n_words long, n_removed long, kept_sha256 string")
