"""Repeated strings of 100 bytes, found by column-wise construction of a collection's
Burrows-Wheeler transform and common prefixes.

All positions of all texts would make too many columns, so the collection is cut down first: a
window of 100 bytes is anchored at the smallest hash of its 16-byte strings, and only windows whose
anchor is repeated, in segments of one anchor, get that far (see repeats). The segments left open
are short strings of bytes. They meet by key; each task takes whole keys, in collections of bounded
size.

A collection is built column by column, from the last to the first: each round inserts one byte per
segment, the one before its present suffix. The bytes in the order of the suffixes are the
transform of that column; sorting it stably gives the order of the next longer suffixes, and the
common prefix of new neighbours with one byte is one more than the smallest common prefix between
their tails. Equal windows hold their anchor at one offset, so segments are laid out with their
anchors in one column, and suffixes of different columns need not be compared: the transform is kept
by columns (its positional form), which takes one row per segment and round, not one per byte.
Windows that are equal then stand together with common prefixes of 100 or more.

The order, the transform and the common prefixes are sequential arrays that are rewritten each
round; because collections are bounded they are held in the task's memory instead of files.

A key with more than FREQUENT different segments is made finer: its windows are cut again where the
next smallest hashes change, as equal windows agree in all of them, so a common string spreads
over as many collections as it has surroundings. What then still has more than TOGETHER segments
around one set of hashes is dealt to several collections; one representative of each class of each
of these meets the others by a fingerprint of two 64-bit halves.

Defined cases: a null text has no bytes. A row without doc_id is left whole and takes no part. Rows
with one doc_id and start are at one place: none is earlier. What is removed is known by doc_id and
text, so rows that share a doc_id keep what only the other one repeats. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm import bitfilter, repeats
from nitrogrid.llm.common import byte_view, mixed, stored
from nitrogrid.llm.repeats import Segments
from nitrogrid.llm.textarrays import range_hash

WINDOW = 100
GRAM = 16
TOGETHER = 8192
FREQUENT, FINER = 1024, 3  # segments of a key that is made finer, by so many more hashes
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_A = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTE_B = mixed(_BYTE_A + _OTHER)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each string of GRAM bytes."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
    eights = np.ascontiguousarray(eights).view(np.uint64).ravel()
    return mixed(mixed(eights[:n]) + eights[8:8 + n] * _OTHER)


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values: suffix minima of one block, prefix minima of the next."""
    n = len(value) - width + 1
    blocks = -(-len(value) // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    table[:len(value)] = value
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def keyed_windows(column: pa.Array, width: int = WINDOW) -> Segments:
    """The segments of a text column: windows by the first place of their smallest gram."""
    raw, first = byte_view(column)
    first = first.astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return Segments(none.view(np.uint64), none, none, first, raw)
    gram = gram_hashes(raw)
    span = width - GRAM + 1
    least = window_minima(gram, span)
    size = np.diff(first)
    windows = np.maximum(size - width + 1, 0)
    place = np.arange(int(windows.sum())) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)
    if not len(place):
        return Segments(none.view(np.uint64), none, none, first, raw)
    value = least[place]
    # runs of windows with one minimum, inside a document
    new = np.ones(len(place), bool)
    new[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    key, start = value[at], place[at]
    count = np.diff(np.append(at, len(place)))
    # the first place of the minimum: the gram that has just come in, or else looked for
    anchor = start + span - 1
    smaller = np.zeros(len(at), bool)
    smaller[1:] = (value[at[1:]] < value[at[1:] - 1]) & (start[1:] == place[at[1:] - 1] + 1)
    for some in np.array_split(np.flatnonzero(~smaller), max(1, len(at) // 20_000)):
        near = gram[start[some][:, None] + np.arange(span)] == key[some][:, None]
        anchor[some] = start[some] + near.argmax(axis=1)
    # runs that go on beyond that place hold the minimum again: cut them at each place of it
    on = start + count - 1 > anchor
    parts = [(key[~on], start[~on], count[~on], anchor[~on])]
    for i in np.flatnonzero(on).tolist():
        s, e = int(start[i]), int(start[i] + count[i])
        places = s + np.flatnonzero(gram[s:e + span - 1] == key[i])
        starts = np.append(s, places[places < e - 1] + 1)
        anchors = places[np.searchsorted(places, starts)]
        parts.append((np.full(len(starts), key[i]), starts, np.diff(np.append(starts, e)), anchors))
    key, start, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Segments(key, start, count, first, raw, anchor - start)


def fingerprint(s: Segments, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(range_hash(_BYTE_A[s.data], start, end)), mixed(range_hash(_BYTE_B[s.data], start, end))


def range_minima(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima over [lo, hi), none empty, of an array with its minima over powers of two."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    found = np.empty(len(lo), np.uint8)
    for k in np.unique(level).tolist():
        on = np.flatnonzero(level == k)
        found[on] = np.minimum(table[k][lo[on]], table[k][hi[on] - (1 << k)])
    return found


def columns(strings: list[bytes], lead: np.ndarray):
    """The suffixes of a collection, column by column from the last: (column, order, common).

    The byte `lead[i]` of string i stands in column 0. order holds the strings that reach the column,
    in the order of their suffixes from it; common is each one's common prefix with the one before.
    A string's end is smaller than every byte and equal to no other end. Strings that begin after
    the column come first and have no common prefix. Strings have at most 255 bytes, none of them
    0xFF (no UTF-8 text has it).
    """
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(size) - size
    lo, hi = -lead, size - lead
    order, common = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    entering = np.argsort(-hi, kind="stable")
    at = 0
    for column in range(int(hi.max()) - 1, int(lo.min()) - 1, -1):
        upto = int(np.searchsorted(-hi[entering], -column, side="left"))
        new, at = entering[at:upto], upto
        if len(new):
            common[:1] = 0
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.uint8), common])
        begun = lo[order] <= column
        transform = np.zeros(len(order), np.uint8)
        transform[begun] = data[base[order[begun]] + column - lo[order[begun]]] + np.uint8(1)
        turn = np.argsort(transform, kind="stable")
        mine = transform[turn]
        same = np.zeros(len(turn), bool)
        same[1:] = (mine[1:] == mine[:-1]) & (mine[1:] > 0)
        k = np.flatnonzero(same)
        following = np.zeros(len(turn), np.uint8)
        if len(k):
            left, right = turn[k - 1] + 1, turn[k] + 1
            table = [common]
            longest = int((right - left).max())
            while 2 << (len(table) - 1) <= longest:
                half = 1 << (len(table) - 1)
                table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            following[k] = 1 + range_minima(table, left, right)
        order, common = order[turn], following
        yield column, order, common


def equal_windows(strings: list[bytes], lead: np.ndarray, doc_id: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows of the strings: (string, offset, is the class's first). First is by (doc_id, start)."""
    size = np.array([len(s) for s in strings])
    # in one column, windows are in the order of their anchors' places
    by_place = np.lexsort((start + lead, doc_id))
    ids, anchors = doc_id[by_place], (start + lead)[by_place]
    later = np.ones(len(strings), bool)
    later[1:] = (ids[1:] != ids[:-1]) | (anchors[1:] != anchors[:-1])
    rank = np.empty(len(strings), np.int64)
    rank[by_place] = np.cumsum(later)
    found = []
    for column, order, common in columns(strings, lead):
        offset = column + lead[order]
        on = np.flatnonzero((offset >= 0) & (size[order] - offset >= width))
        if not len(on):
            continue
        opens = np.ones(len(on), bool)
        opens[1:] = ~((on[1:] == on[:-1] + 1) & (common[on[1:]] >= width))
        heads = np.flatnonzero(opens)
        mine = rank[order[on]]
        least = np.repeat(np.minimum.reduceat(mine, heads), np.diff(np.append(heads, len(on))))
        found.append((order[on], offset[on], mine == least))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def made_finer(gram: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, span: int, times: int = FINER):
    """Segments (start, count) of windows that share a key, cut where the windows' next smallest gram hashes change.

    Gives, for each new segment, the old one's number, its start and count, and a key that the
    window's content decides: the smallest hashes of the span grams of a window, one after another.
    """
    old = np.arange(len(key))
    seen = [key]
    for _ in range(times):
        grams = count + span - 1
        begin = np.cumsum(grams) - grams
        value = gram[np.arange(int(grams.sum())) + np.repeat(start - begin, grams)]
        for smaller in seen:
            value[value == np.repeat(smaller, grams)] = np.iinfo(np.uint64).max
        owner = np.repeat(np.arange(len(count)), count)
        window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        least = window_minima(value, span)[begin[owner] + window]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        at = np.flatnonzero(new)
        of = owner[at]
        old, start, count = old[of], start[of] + window[at], np.diff(np.append(at, len(owner)))
        key = mixed(key[of] * _OTHER + least[at])
        seen = [*(x[of] for x in seen), least[at]]
    return old, start, count, key


def opened_windows(width: int):
    """Repeats among open segments by the sorted suffixes of bounded collections."""

    def opened(rows: DataFrame, packed: np.ndarray, several: DataFrame) -> DataFrame:
        context = rows.sparkSession.sparkContext
        frequent = stored(several.where(F.col("segments") > FREQUENT), "repeat-frequent")
        finer = context.broadcast(bitfilter.key_filter(frequent.select("key"), frequent.count()))
        each = repeats.open_segments(rows, lambda c: keyed_windows(c, width), packed)

        def emit(batches):
            for s, on, ids, text_keys, place in each(batches):
                key, start, count, lead = s.key[on], s.start[on], s.count[on], s.lead[on]
                often = bitfilter.passes(finer.value, key)
                of = np.flatnonzero(often)
                if len(of):
                    old, begin, n, home = made_finer(gram_hashes(s.data), key[of], start[of], count[of], width - GRAM + 1)
                    old = of[old]
                    calm = np.flatnonzero(~often)
                    number = np.concatenate([calm, old])
                    shift = np.concatenate([np.zeros(len(calm), np.int64), begin - start[old]])
                    key, count = np.concatenate([key[calm], home]), np.concatenate([count[calm], n])
                    often = np.concatenate([often[calm], np.ones(len(old), bool)])
                    start, lead = start[number] + shift, lead[number] - shift
                    ids, text_keys, place = ids[number], text_keys[number], place[number] + shift
                raw = s.data.tobytes()
                pieces = [raw[a:b] for a, b in zip(start.tolist(), (start + count + width - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(often), pa.array(ids), pa.array(text_keys), pa.array(place),
                     pa.array(lead.astype(np.int32)), pa.array(pieces, pa.binary())],
                    names=["home", "often", "doc_id", "text_key", "start", "lead", "piece"])

        pieces = stored(rows.mapInArrow(
            emit, "home long, often boolean, doc_id long, text_key long, start long, lead int, piece binary"), "repeat-pieces")
        crowded = stored(pieces.where("often").groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER)
                         .select(F.col("home").alias("crowd"), F.ceil(F.col("n") / TOGETHER).alias("shares")), "repeat-crowded")
        share = F.pmod(F.xxhash64("doc_id", "start"), F.col("shares"))
        pieces = pieces.join(crowded, pieces["home"] == crowded["crowd"], "left").select(
            F.when(F.col("shares").isNull(), F.col("home")).otherwise(F.xxhash64("home", share)).alias("home"),
            F.col("shares").isNotNull().alias("hot"), "doc_id", "text_key", "start", "lead", "piece")
        shape = "doc_id long, text_key long, start long, windows long, fa long, fb long"

        def collections(batches):
            """Rows of whole homes, TOGETHER or a few more at a time. Rows come in order of their homes."""
            held, rows_held = [], 0
            for batch in batches:
                home = batch.column("home").to_numpy()
                cuts = np.append(np.flatnonzero(home[1:] != home[:-1]) + 1, batch.num_rows)
                if held and batch.num_rows and home[0] != held[-1].column("home")[-1].as_py() and rows_held >= TOGETHER:
                    yield pa.Table.from_batches(held)
                    held, rows_held = [], 0
                at = 0
                for cut in cuts.tolist():
                    if cut == batch.num_rows:
                        break
                    if rows_held + cut - at >= TOGETHER:
                        yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
                        held, rows_held, at = [], 0, cut
                if at < batch.num_rows:
                    held.append(batch.slice(at))
                    rows_held += batch.num_rows - at
            if held:
                yield pa.Table.from_batches(held)

        def solve(batches):
            for t in collections(batches):
                strings = t.column("piece").to_pylist()
                ids, text_keys, starts = (t.column(c).to_numpy() for c in ("doc_id", "text_key", "start"))
                hot_rows = t.column("hot").to_numpy()
                lead = t.column("lead").to_numpy().astype(np.int64)
                string, offset, first = equal_windows(strings, lead, ids, starts, width)
                order = np.lexsort((offset, string))
                string, offset, first = string[order], offset[order], first[order]
                # runs of later windows of one string
                on = np.flatnonzero(~first)
                s, o = string[on], offset[on]
                new = np.ones(len(on), bool)
                new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
                at = np.flatnonzero(new)
                zero = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s[at]]), pa.array(text_keys[s[at]]), pa.array(starts[s[at]] + o[at]),
                     pa.array(np.diff(np.append(at, len(on)))), pa.array(zero), pa.array(zero)],
                    names=["doc_id", "text_key", "start", "windows", "fa", "fb"])
                on = np.flatnonzero(first & hot_rows[string])
                if len(on):
                    raw = np.frombuffer(b"".join(strings), np.uint8)
                    base = np.cumsum([0, *map(len, strings)])[:-1]
                    at = base[string[on]] + offset[on]
                    fa, fb = (mixed(range_hash(b[raw], at, at + width)).view(np.int64) for b in (_BYTE_A, _BYTE_B))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[string[on]]), pa.array(text_keys[string[on]]), pa.array(starts[string[on]] + offset[on]),
                         pa.array(np.zeros(len(on), np.int64)), pa.array(fa), pa.array(fb)],
                        names=["doc_id", "text_key", "start", "windows", "fa", "fb"])

        solved = stored(pieces.repartition("home").sortWithinPartitions("home").mapInArrow(solve, shape), "repeat-solved")
        later = solved.where("windows > 0").select(
            "doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + width - 1).alias("hi"))
        heads = solved.where("windows = 0")
        best = heads.groupBy("fa", "fb").agg(F.min(F.struct("doc_id", "start")).alias("head"), F.count("*").alias("n")) \
            .where("n > 1").select("fa", "fb", "head")
        across = (
            heads.join(best, ["fa", "fb"])
            .where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("start") != F.col("head.start")))
            .select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))
        )
        return later.unionByName(across)

    return opened


def cut_bytes(batches):
    for batch in batches:
        columns = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        raw, first = byte_view(batch.column("text"))
        raw, first = raw.tobytes(), first.tolist()
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            text = memoryview(raw)[first[i]:first[i + 1]]
            spans = repeats.merged([(r["lo"], r["hi"]) for r in ranges], len(text))
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            columns["n_bytes"].append(len(text))
            columns["n_removed"].append(sum(hi - lo for lo, hi in spans))
            columns["n_spans"].append(len(spans))
            columns["kept_sha256"].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [columns["doc_id"], *(pa.array(columns[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")),
             pa.array(columns["kept_sha256"], pa.string())], names=list(columns))


def repeated_bytes(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, lo, hi): the ranges of bytes to remove; they may overlap."""
    return repeats.repeated_ranges(docs, lambda c: keyed_windows(c, width), fingerprint, width, opened_windows(width))


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats.cut_texts(docs, repeated_bytes(docs, width), cut_bytes,
                             "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
