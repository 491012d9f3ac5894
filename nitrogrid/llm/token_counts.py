"""Token counts of a sentencepiece BPE model by rank-synchronous merging.

A text is cut at places that no piece of the vocabulary spans, so its pre-tokens merge
independently. New pre-tokens of a batch lie in ragged numpy arrays (symbol ids, next symbol,
owner); each round applies, in every sequence at once, the pair of the lowest rank (leftmost of
equal ones), until no pair of any sequence is in the vocabulary. What survives is counted; a symbol
outside the vocabulary counts its UTF-8 bytes. A very long pre-token holds its places by rank, and a
round applies its lowest rank at all places of it, so a round touches the places that change only.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nitrogrid.llm.common import id_and_text, texts

LIMIT = 4096
MARK = "▁"
NO_RANK = np.int64(1 << 40)
LONG = 2048
CACHED = 500_000
TOGETHER = 1 << 16

_loaded: dict[str, "Merger"] = {}


class Merger:
    """The vocabulary of a model as arrays, and counts of the pre-tokens met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        chars = sorted({c for p in pieces for c in p})
        self.symbols: dict[str, int] = {c: i for i, c in enumerate(chars)}
        for p in pieces:
            self.symbols.setdefault(p, len(self.symbols))
        self.width = len(self.symbols) + 1
        self.cost = np.ones(self.width, np.int64)  # the last symbol stands for all unknown characters
        for c in chars:
            if c not in pieces:
                self.cost[self.symbols[c]] = len(c.encode())
        pairs = {}
        for p, score in pieces.items():
            for i in range(1, len(p)):
                left, right = self.symbols.get(p[:i]), self.symbols.get(p[i:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (order[score], self.symbols[p])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_made = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int64)
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        # no piece goes on to a mark after another character, as the cutting pattern needs
        assert not any(a != MARK and b == MARK for a, b in self.inside)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
        self.counts: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NO_RANK: not in the vocabulary) and what it becomes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NO_RANK), np.where(known, self.pair_made[at], -1)

    def text_counts(self, batch: list[str]) -> list[int]:
        words = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        if len(self.counts) > CACHED:
            self.counts = {}
        new = set().union(*words) - self.counts.keys()
        fresh = sorted(w for w in new if len(w) <= LONG)
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at:at + TOGETHER]
            self.counts.update(zip(some, self.merged(some).tolist(), strict=True))
        for w in new:
            if len(w) > LONG:
                self.counts[w] = self.parts_count(Counter(self.parts(w)))
        get = self.counts.__getitem__
        found = [sum(map(get, w)) for w in words]
        for w in new:
            if len(w) > LONG:  # long ones are not kept
                del self.counts[w]
        return found

    def parts(self, word: str) -> list[str]:
        """A long pre-token, cut where two characters stand together in no piece."""
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def parts_count(self, times: Counter) -> int:
        """The count of parts that stand so many times; short ones merge together."""
        short = sorted(p for p in times if len(p) <= LONG)
        total = sum(self.long_count(p) * k for p, k in times.items() if len(p) > LONG)
        for at in range(0, len(short), TOGETHER):
            some = short[at:at + TOGETHER]
            total += int(self.merged(some) @ np.array([times[p] for p in some]))
        return total

    def start(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of the characters, and how many tokens each counts while it is alone."""
        other = self.width - 1
        ids = np.fromiter((self.symbols.get(c, other) for c in joined), np.int64, len(joined))
        cost = self.cost[ids]
        for i in np.flatnonzero(ids == other).tolist():
            cost[i] = len(joined[i].encode())
        return ids, cost

    def merged(self, words: list[str]) -> np.ndarray:
        """The token counts of many pre-tokens, all merged at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, cost = self.start("".join(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        result = np.zeros(len(words), np.int64)
        while len(ids):
            same = np.zeros(len(ids), bool)
            same[:-1] = owner[1:] == owner[:-1]
            rank, made = self.ranks(ids, np.append(ids[1:], 0))
            rank = np.where(same, rank, NO_RANK)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            going = lowest < NO_RANK
            result[owner[first]] += np.where(going, 0, np.add.reduceat(cost, first))
            length = np.diff(np.append(first, len(ids)))
            alive = np.repeat(going, length)
            best = np.flatnonzero(alive & (rank == np.repeat(lowest, length)))
            best = best[np.append(True, owner[best][1:] != owner[best][:-1])] if len(best) else best
            ids[best] = made[best]
            cost[best] = self.cost[ids[best]]
            alive[best + 1] = False
            ids, cost, owner = ids[alive], cost[alive], owner[alive]
        return result

    def long_count(self, part: str) -> int:
        """The count of one long sequence: each round applies the lowest rank at all its places, from the left.

        While what a round makes pairs at higher ranks only, merging its places together is the same as one
        after the other; a round ends at the first place whose new symbol has a pair that comes no later.
        """
        ids, cost = self.start(part)
        n = len(ids)
        rank, made = np.full(n, NO_RANK), np.full(n, -1, np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        gone = np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def hold(places):
            """Notes places by their rank."""
            places = places[rank[places] < NO_RANK]
            places = places[np.argsort(rank[places], kind="stable")]
            edges = np.flatnonzero(np.diff(rank[places])) + 1
            for some in np.split(places, edges) if len(places) else ():
                r = int(rank[some[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(some)

        rank[:n - 1], made[:n - 1] = self.ranks(ids[:-1], ids[1:])
        hold(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[~gone[places] & (rank[places] == r)]
            if not len(places):
                continue
            # of places that overlap, each second one from the left
            linked = np.append(False, after[places[:-1]] == places[1:])
            step = np.arange(len(places))
            taken = places[(step - np.maximum.accumulate(np.where(linked, 0, step))) % 2 == 0]
            right = after[taken]
            follow = after[right]
            new = made[taken]
            # the neighbours of each new symbol when it is made: those to the left have merged, those to the right have not
            left = np.where(before[taken] >= 0, ids[before[taken]], -1)
            left[1:] = np.where(before[taken[1:]] == right[:-1], new[:-1], left[1:])
            next_one = np.where(follow < n, ids[np.minimum(follow, n - 1)], -1)
            early = np.flatnonzero((self.ranks(left, new)[0] <= r) | (self.ranks(new, next_one)[0] <= r))
            if len(early):
                k = int(early[0]) + 1
                hold(places[places > taken[k - 1]])
                taken, right, follow = taken[:k], right[:k], follow[:k]
            places = taken
            ids[places] = made[places]
            cost[places] = self.cost[ids[places]]
            gone[right], rank[right] = True, NO_RANK
            after[places] = follow
            inner = follow < n
            before[follow[inner]] = places[inner]
            changed = np.unique(np.concatenate([before[places], places]))
            changed = changed[changed >= 0]
            ahead = after[changed]
            rank[changed[ahead == n]] = NO_RANK
            changed, ahead = changed[ahead < n], ahead[ahead < n]
            rank[changed], made[changed] = self.ranks(ids[changed], ids[ahead])
            hold(changed)
        return int(cost[~gone].sum())


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. path: the model's file."""

    def count(batches):
        where = path or model_file()
        if where not in _loaded:
            _loaded[where] = Merger(where)
        for batch in batches:
            found = texts(batch)
            n = _loaded[where].text_counts(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
