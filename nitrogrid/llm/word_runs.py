"""Periodic runs of words, found by a suffix automaton whose link tree is a link-cut tree.

Words are appended one by one. The suffixes that end at the new word are the path from its state to
the root of the suffix links. Accessing that path recolours it with the new end; each piece of it
that carried one earlier end says that its longest word string ended there last. Where the new end
is no further away than that string is long, both occurrences touch or overlap: a square, whose
period is the distance. The string is the longest one common to both ends, so the stretch begins
where the string that ends earlier begins, and it is a run up to the last end that reports the same
beginning and period. A stretch of at least four periods reports its smallest period at every end
from its third period on, and reports no other (two periods p < q of a stretch of p + q words share
their greatest common divisor).

Before that, places that cannot lie in a run of at least max(6, 4 periods) words are cut out: each
three words in a row of such a run occur three times in it. What is left between the cuts is cut
again until nothing changes, so ordinary prose hardly reaches the automaton and a run always reaches
it whole. Hashes serve in this filter only; the automaton compares the words themselves.

Defined cases: a null text, or one without words, has no words and no run. A row without doc_id is
never filled with a period by `planted`. Repeated rows are judged each. An empty table gives an
empty result. Other columns are ignored. Texts are handled whole; batches are cut by bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nitrogrid.llm.common import id_and_text, mixed, pieces_of
from nitrogrid.llm.textarrays import words

LEAST = 6      # words of a run
PERIODS = 4    # periods of a run
GRAM, TIMES = 3, 3
BATCH_BYTES = 1 << 20


class Runs:
    """The runs of one sequence, word by word.

    The automaton has arrays of one entry per state: transitions, length of the longest string and
    (while a state is new) its suffix link. The links themselves live in the link-cut tree: each
    preferred path is a splay tree ordered by depth, `up` of a splay root leads to the path above,
    and `end` of a splay root is the last end of the whole path.
    """

    def __init__(self, least: int = LEAST, periods: int = PERIODS):
        self.least, self.periods = least, periods
        self.next: list[dict[int, int]] = [{}]
        self.length = [0]
        self.link = [-1]
        self.left, self.right, self.up = [-1], [-1], [-1]
        self.end = [0]
        self.last = 0
        self.n = 0
        self.found: dict[tuple[int, int], int] = {}

    def state(self, transitions: dict[int, int], length: int, link: int, end: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(link)
        self.end.append(end)
        return len(self.length) - 1

    def splay(self, x: int):
        """Makes x the root of the splay tree of its path."""
        left, right, up = self.left, self.right, self.up
        first = True
        while True:
            p = up[x]
            if p < 0:
                return
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                return
            if first:
                first = False
                top = p  # the root hands the end of the path to x
                while (g := up[top]) >= 0 and (left[g] == top or right[g] == top):
                    top = g
                self.end[x] = self.end[top]
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                # straight lines turn the upper edge first, bends the lower one
                self.turn(p if (left[g] == p) == on_left else x)
            self.turn(x)

    def turn(self, x: int):
        """Rotates x above its parent."""
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, x: int):
        """Recolours the path from x to the root with the present end and reports its earlier ends."""
        left, right, up, end = self.left, self.right, self.up, self.end
        now, below = self.n, -1
        while x >= 0:
            self.splay(x)
            before, size = end[x], self.length[x]
            if before:
                period = now - before
                if size >= (self.periods - 1) * period and size + period >= self.least:
                    self.found[now - size - period, period] = now
            lower = right[x]
            if lower >= 0:
                end[lower] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = now

    def append(self, word: int):
        """One more word: the automaton's new state, a split where a string ends a state no more, and the access."""
        following, length, link = self.next, self.length, self.link
        p, self.n = self.last, self.n + 1
        new = self.state({}, self.n, 0, 0)
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[q] != length[p] + 1:
                q = self.split(p, q, word)
            link[new] = self.up[new] = q
        self.last = new
        self.access(new)

    def split(self, p: int, q: int, word: int) -> int:
        """The shorter strings of q become a state of their own, right above q on q's path."""
        self.splay(q)
        part = self.state(dict(self.next[q]), self.length[p] + 1, self.link[q], 0)
        above = self.left[q]
        self.left[part] = above
        if above >= 0:
            self.up[above] = part
        self.left[q], self.up[part] = part, q
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def runs(self, sequence: list[int]) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the sequence."""
        for word in sequence:
            self.append(word)
        return [(start, end - start, period) for (start, period), end in self.found.items()]


def candidates(values: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of places that hold all runs; owner numbers the document of each place.

    A run of n words and period q has n - 2 >= 3 q of its groups of three words (four if q = 1), so
    each such group stands there three times at least.
    """
    place = np.arange(len(values))
    stretch = owner
    while len(place):
        n = len(place)
        together = np.zeros(n, bool)
        if n >= GRAM:
            together[:n - GRAM + 1] = (stretch[GRAM - 1:] == stretch[:n - GRAM + 1])
        at = np.flatnonzero(together)
        gram = mixed(stretch[at].astype(np.uint64))
        for k in range(GRAM):
            gram = mixed(gram + values[place[at + k]])
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(at) else at
        count = np.diff(np.append(first, len(at)))
        often = at[order[np.repeat(count >= TIMES, count)]]
        alive = np.zeros(n, bool)
        for k in range(GRAM):
            alive[often + k] = True
        kept = np.flatnonzero(alive)
        new = np.append(True, (kept[1:] != kept[:-1] + 1) | (stretch[kept[1:]] != stretch[kept[:-1]])) if len(kept) else alive[:0]
        number = np.cumsum(new) - 1
        size = np.bincount(number, minlength=1)
        long = size[number] >= LEAST if len(kept) else alive[:0]
        if len(kept) == n and long.all():
            edges = np.flatnonzero(new)
            return list(zip(place[edges].tolist(), (place[np.append(edges[1:], n) - 1] + 1).tolist(), strict=True))
        place, stretch = place[kept[long]], number[long]
    return []


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a document whose checksum says so: which of its own words stands at each place from then on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def as_they_are(doc_id: int | None, n: int) -> None:
    return None


def batch_runs(part: pa.RecordBatch, source=as_they_are):
    """(words, their order, runs) of each document of a batch; words as bytes.

    source(doc_id, n) may name other words of the document for its places.
    """
    w = words(part.column("text"))
    edges = w.first.tolist()
    ids = part.column("doc_id").to_pylist()
    order = np.arange(len(w.hashes))
    moved = [source(i, b - a) for i, a, b in zip(ids, edges, edges[1:])]
    for a, b, m in zip(edges, edges[1:], moved):
        if m is not None:
            order[a:b] = a + m
    owner = np.repeat(np.arange(len(ids)), np.diff(w.first))
    raw = w.raw.tobytes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for lo, hi in candidates(w.hashes[order], owner):
        doc = int(owner[lo])
        numbers: dict[bytes, int] = {}
        some = order[lo:hi]
        sequence = [numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(w.start[some].tolist(), w.end[some].tolist(), strict=True)]
        found[doc] += [(lo - edges[doc] + start, size, period) for start, size, period in Runs().runs(sequence)]
    for k, runs in enumerate(found):
        at = order[edges[k]:edges[k + 1]]
        yield raw, w.start[at], w.end[at], sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: all but those behind the first period of a run."""
    gone = np.zeros(n + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return np.cumsum(gone[:n]) == 0


def joined(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words from start to end, joined by one space."""
    return b" ".join(map(raw.__getitem__, map(slice, start.tolist(), end.tolist())))


def word_runs(docs: DataFrame, source=as_they_are) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period), collapsed text."""

    def find(batches):
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES):
                rows = [(runs, joined(raw, start[k], end[k]).decode()) for raw, start, end, runs in batch_runs(part, source)
                        for k in [kept_words(len(start), runs)]]
                runs, collapsed = zip(*rows, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in runs]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(listed, kind), pa.array(collapsed, pa.string())],
                                                 names=["doc_id", "runs", "collapsed"])

    return id_and_text(docs).mapInArrow(
        find, "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, exactly; of equal ones the first, then the shorter period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def run_digests(docs: DataFrame, source=planted) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""

    def find(batches):
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES):
                rows = []
                for raw, start, end, runs in batch_runs(part, source):
                    best = strongest(runs)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    keep = kept_words(len(start), runs)
                    rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                                 hashlib.sha256(listed.encode()).hexdigest(),
                                 hashlib.sha256(joined(raw, start[keep], end[keep])).hexdigest()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return id_and_text(docs).mapInArrow(
        find, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
              "collapsed_sha256 string")
