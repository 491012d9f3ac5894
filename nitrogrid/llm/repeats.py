"""Which windows of a collection were seen before: the part that both substring operators share.

A window is a run of `width` symbols of one document (words or bytes). A keyer gives each window an
anchor: a place inside it that depends on the window's content only, and a key, the hash of what
stands there. Equal windows have equal keys at equal offsets. Neighbouring windows of one anchor
form a segment, so there are far fewer segments than windows.

1. Spark counts the keys of all segments. A window can be repeated only if its key is.
2. Segments of repeated keys are written out as fingerprints and grouped. A segment that is equal,
   as a whole, to an earlier one is a repeat with all its windows. What is left open are the first
   segments of keys that have several different ones.
3. Only those are opened; the operator finds the equal windows among them by its own method.
4. The covered ranges meet the texts, and only texts that have any shuffle.

Filters are Bloom filters of bounded size that spare shuffles; joins decide. Hot keys are split by
the joins' skew handling, as both sides of each are read from stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm import bitfilter
from nitrogrid.llm.common import mixed, pieces_of, stored, with_text_key

BATCH_BYTES = 1 << 19


@dataclass
class Segments:
    """Segments of a batch: arrays of one entry each, places counted in symbols of the whole batch."""
    key: np.ndarray    # uint64
    start: np.ndarray  # first window
    count: np.ndarray  # windows
    first: np.ndarray  # per document its first symbol; one more entry than documents
    data: object       # what the keyer wants to know again
    lead: np.ndarray | None = None  # from the segment's start to its anchor

    def documents(self) -> np.ndarray:
        return np.searchsorted(self.first, self.start, side="right") - 1


#: text column to segments; fingerprints of ranges of symbols (two 64-bit halves)
Keyer = Callable[[pa.Array], Segments]
Fingerprint = Callable[[Segments, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def by_anchor(key: np.ndarray, anchor: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (key, start, count) of windows at the given places (ascending) with their anchors."""
    if not len(place):
        return key, place, place
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return key[at], place[at], np.diff(np.append(at, len(place)))


def occurrence(doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of where a segment begins."""
    return mixed(mixed(doc_id.astype(np.int64).view(np.uint64)) + place.astype(np.uint64))


def segments_of(keyer: Keyer, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Segments]]:
    for part in pieces_of(batch, BATCH_BYTES):
        yield part, keyer(part.column("text"))


def key_counts(rows: DataFrame, keyer: Keyer) -> DataFrame:
    """The keys that stand in more than one segment."""

    def count(batches):
        for batch in batches:
            for _, s in segments_of(keyer, batch):
                key, n = np.unique(s.key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def fingerprinted(rows: DataFrame, keyer: Keyer, fingerprint: Fingerprint, width: int, packed: np.ndarray) -> DataFrame:
    """Segments whose key passes the filter: key, fa, fb, doc_id, start (in the document), count, occurrence."""
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def emit(batches):
        for batch in batches:
            for part, s in segments_of(keyer, batch):
                on = np.flatnonzero(bitfilter.passes(shared.value, s.key))
                if not len(on):
                    continue
                doc = s.documents()[on]
                ids, text_keys = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "text_key"))
                start, count = s.start[on], s.count[on]
                fa, fb = fingerprint(s, start, start + count + width - 1)
                place = start - s.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (s.key[on].view(np.int64), fa.view(np.int64), fb.view(np.int64), ids, text_keys,
                                           place, count, occurrence(ids, place).view(np.int64))],
                    names=["key", "fa", "fb", "doc_id", "text_key", "start", "count", "occurrence"])

    return rows.mapInArrow(
        emit, "key long, fa long, fb long, doc_id long, text_key long, start long, count long, occurrence long")


def repeated_ranges(docs: DataFrame, keyer: Keyer, fingerprint: Fingerprint, width: int,
                    opened: Callable[[DataFrame, np.ndarray, DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, text_key, lo, hi): ranges of symbols covered by windows that also start earlier.

    text_key is a hash of the text: with the doc_id it names the text, or equal ones, of one document.

    opened(rows, packed, hot) finds the repeats among the segments left open: packed is a filter of
    their occurrences, hot has the keys (key, segments) of them all.
    """
    rows = with_text_key(docs).where("doc_id is not null and text is not null")
    keys = stored(key_counts(rows, keyer), "repeat-keys")
    packed = bitfilter.key_filter(keys, keys.count())
    found = stored(fingerprinted(rows, keyer, fingerprint, width, packed), "repeat-segments")
    # one row per different segment, with its first place
    place = F.struct("doc_id", "start", "occurrence", "count")
    different = stored(found.groupBy("key", "fa", "fb").agg(F.min(place).alias("head")), "repeat-different")
    later = (
        found.join(different, ["key", "fa", "fb"])
        .where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("start") != F.col("head.start")))
        .select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + F.col("count") + width - 1).alias("hi"))
    )
    several = stored(different.groupBy("key").agg(F.count("*").alias("segments")).where("segments > 1"), "repeat-several")
    heads = stored(different.join(several, "key").select(F.col("head.occurrence").alias("key")), "repeat-open")
    open_filter = bitfilter.key_filter(heads, heads.count())
    return later.unionByName(opened(rows, open_filter, several))


def open_segments(rows: DataFrame, keyer: Keyer, packed: np.ndarray):
    """An iterator factory over (segments, numbers of the open ones, their ids, text keys, places)."""
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def each(batches):
        for batch in batches:
            for part, s in segments_of(keyer, batch):
                doc = s.documents()
                ids, text_keys = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "text_key"))
                place = s.start - s.first[doc]
                on = np.flatnonzero(bitfilter.passes(shared.value, occurrence(ids, place)))
                if len(on):
                    yield s, on, ids[on], text_keys[on], place[on]

    return each


def merged(ranges: list, size: int) -> list[tuple[int, int]]:
    """Ranges without overlap, in order; ranges that touch are one."""
    found: list[list[int]] = []
    for lo, hi in sorted(ranges):
        hi = min(hi, size)
        if found and lo <= found[-1][1]:
            found[-1][1] = max(found[-1][1], hi)
        else:
            found.append([lo, hi])
    return [(a, b) for a, b in found]


def cut_texts(docs: DataFrame, ranges: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """cut(batch with doc_id, text, ranges) over all rows; rows without ranges stay where they are."""
    spark = docs.sparkSession
    grouped = stored(
        ranges.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
        .withColumnsRenamed({"doc_id": "range_id", "text_key": "range_key"}), "repeat-ranges")
    packed = bitfilter.key_filter(grouped.select(F.xxhash64("range_id", "range_key").alias("key")), grouped.count())
    maybe = bitfilter.tester(spark, packed)
    rows = with_text_key(docs).withColumn("touched", F.col("doc_id").isNotNull() & maybe(F.xxhash64("doc_id", "text_key")))
    empty = F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")
    whole = rows.where(~F.col("touched")).select("doc_id", "text", empty.alias("ranges"))
    touched = rows.where("touched")
    touched = touched.join(grouped, (touched["doc_id"] == grouped["range_id"]) & (touched["text_key"] == grouped["range_key"]), "left") \
        .select("doc_id", "text", F.coalesce("ranges", empty).alias("ranges"))
    return whole.mapInArrow(cut, schema).unionByName(touched.mapInArrow(cut, schema))
