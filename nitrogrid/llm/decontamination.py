"""Benchmark passages in documents, found in a latent semantic space and then checked word by word.

1. Texts become numbers of benchmark words once, for all later steps. Spark counts in how many documents each
   of these words stands. The features are each item's words of at most MAX_SHARE of the documents, and
   its FEW rarest words anyway.
2. A distributed randomised SVD of the TF-IDF matrix A of passages gives the latent space. Its rows are
   the passages of all documents and all benchmark items, weighted to count as much as the passages
   together. The documents are read once for the products transposed(A) A of features that share a
   passage; each step then multiplies these with a small matrix, and only features x RANK sums come back.
3. Every window of every document is projected; items with a cosine of COSINE or more are candidates.
   Items of at most STRIDE words are held against windows of WINDOW - STRIDE words as well. Whatever the
   cosine, an item that shares RUN words in a row with the document is a candidate at that place.
4. A candidate stays if the longest common subsequence of words has LCS of the item's words and
   at least ANSWER of the words of its last sentence, which holds the answer, stand in the window.

Benchmarks of more than ITEMS_TOGETHER items are searched in parts, each with a latent space of its own,
so that a space has about as many dimensions as items and what is sent to the tasks is bounded. Every
document is searched whole: windows of WINDOW words begin every STRIDE words, and an item of
more than WINDOW - STRIDE words is searched by overlapping parts.

Defined cases: null or empty texts, and items without words, match nothing. Of repeated rows or items
each pair is given once. A row without doc_id is in no pair; `without_contaminated` judges every row
by its own text, also those without doc_id and those that share one. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm.common import mixed, pieces_of, ship, stored, texts, tidy, with_text_key

WINDOW, STRIDE = 96, 32
MAX_SHARE, FEW = 0.05, 8
RANK, OVERSAMPLE, POWER_STEPS = 256, 16, 2
COSINE, LCS, ANSWER = 0.4, 0.65, 0.5
RUN = 5
ITEMS_TOGETHER = RANK
SEED = 20_240_607
BATCH_BYTES = 340 << 10  # of word numbers; about what 512 KB of text have
TOGETHER = 128  # rows of the feature products that are multiplied at once
HELD = 1 << 20  # products of features that a task holds before it adds them up
# each task sends sums of its own, so few tasks add up much: word numbers, and products, whose number the benchmark bounds
ADDED_BYTES, MULTIPLIERS = 16 << 20, 4
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")

MATCH = "doc_id long, item_id long, word long, cosine double, lcs double, answer double"
KEYED_MATCH = MATCH + ", text_key long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Part:
    """An item, or an overlapping part of a long one."""
    item: int
    words: list[str]
    answer: list[str]


def parts_of(rows: list[tuple[int, str]]) -> list[Part]:
    longest = WINDOW - STRIDE
    found = []
    for item, text in rows:
        words = words_of(text)
        sentences = [s for s in map(words_of, SENTENCE.split(text)) if s]
        if not words:
            continue
        if len(words) <= longest:
            found.append(Part(item, words, sentences[-1][-longest:]))
            continue
        for at in range(0, len(words) - longest // 2, longest // 2):
            some = words[at:at + longest]
            found.append(Part(item, some, some[-FEW:]))
    return found


def vocabulary_of(parts: list[Part]) -> list[str]:
    return sorted({w for p in parts for w in p.words})


def numbers_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The numbers of the words; -1 for all others."""
    return np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))


def numbered(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, text_key and the word numbers of each text (32 bits each), as a stored table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches):
        known = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            ids = [numbers_of(words_of(text), known).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(ids, pa.binary())], names=["doc_id", "text_key", "ids"])

    return stored(with_text_key(docs).mapInArrow(tidy(number), "doc_id long, text_key long, ids binary"), "leak-words")


def numbers_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int32) for v in batch.column("ids").to_pylist()]


def document_counts(numbers: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands."""
    size = len(vocabulary)

    def count(batches):
        met = np.zeros(size, np.int64)
        for batch in batches:
            for ids in numbers_in(batch):
                met[np.unique(ids[ids >= 0])] += 1
        on = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(met[on])], names=["word", "n"])

    rows = numbers.select("ids").mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r["word"]]: r["n"] for r in rows.collect()}


def chosen_features(parts: list[Part], met: dict[str, int], docs: int) -> tuple[dict[str, int], np.ndarray]:
    """Features and their inverse document frequencies."""
    chosen = set()
    for p in parts:
        by_rarity = sorted(set(p.words), key=lambda w: (met.get(w, 0), w))
        chosen.update(by_rarity[:FEW])
        chosen.update(w for w in by_rarity if met.get(w, 0) <= MAX_SHARE * docs)
    names = sorted(chosen)
    idf = np.array([np.log((1 + docs) / (1 + met.get(w, 0))) + 1e-3 for w in names])
    return {w: i for i, w in enumerate(names)}, idf


def feature_numbers(vocabulary: list[str], place: dict[str, int]) -> np.ndarray:
    """Features of the words of a vocabulary, -1 for words that are none; the last place is for all other words."""
    return np.array([*(place.get(w, -1) for w in vocabulary), -1], np.int64)


def counts_of(words: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text by word position: (position, feature)."""
    found = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def randomised_svd(products: DataFrame, own: list[tuple[np.ndarray, np.ndarray]], weight: float, features: int,
                   rank: int = RANK) -> np.ndarray:
    """Right singular vectors (features x rank) of the passages whose products are given, together with the
    rows `own`, times weight. Each pass adds up, in Spark, transposed(A) A Q; each of MULTIPLIERS tasks sends
    features x width sums at most, however many partitions the products have."""
    width = min(features, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((features, width)))[0]
    context = products.sparkSession.sparkContext

    for _ in range(POWER_STEPS + 1):
        shared = context.broadcast(q)

        def product(batches, shared=shared):
            basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(at, TOGETHER)
                    mine = some.column("feature").to_numpy()
                    others, values = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("other", "value"))
                    row = np.repeat(np.arange(len(mine)), some.column("other").value_lengths().to_numpy())
                    met, place = np.unique(others, return_inverse=True)
                    block = np.zeros((len(mine), len(met)))
                    block[row, place] = values
                    total[mine] += block @ basis[met]
                    # both orders of a pair, but a feature with itself once
                    block[np.arange(len(mine)), np.searchsorted(met, mine)] = 0
                    total[met] += block.T @ basis[mine]
            on = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(on, pa.int64()), pa.array([r.tobytes() for r in total[on]], pa.binary())], names=["feature", "row"])

        def added(pdf):
            import pandas as pd

            total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
            return pd.DataFrame({"feature": [int(pdf["feature"].iloc[0])], "row": [total.tobytes()]})

        # a group has one row per task, of a row of the small matrix
        summed = products.coalesce(MULTIPLIERS).mapInArrow(tidy(product), "feature long, row binary") \
            .groupBy("feature").applyInPandas(added, "feature long, row binary")
        z = np.zeros_like(q)
        for feature, value in own:
            np.add.at(z, feature, weight ** 2 * np.outer(value, value @ q[feature]))
        for r in summed.coalesce(MULTIPLIERS).toLocalIterator():
            z[r["feature"]] += np.frombuffer(r["row"])
        vectors, _, _ = np.linalg.svd(z, full_matrices=False)
        q = vectors
    return q[:, :rank]


def passage_rows(texts_ids: list[np.ndarray], feature: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts as sparse unit rows: (window, feature, value), in order."""
    size = np.array([len(ids) for ids in texts_ids], np.int64)
    first = np.cumsum(np.append(0, size))[:-1]
    windows = -(-size // WINDOW)
    before = np.cumsum(np.append(0, windows))[:-1]
    found = feature[np.concatenate([np.zeros(0, np.int32), *texts_ids])]
    at = np.flatnonzero(found >= 0)
    text = np.repeat(np.arange(len(size)), size)[at]
    cell, times = np.unique((before[text] + (at - first[text]) // WINDOW) * len(idf) + found[at], return_counts=True)
    window, which = cell // len(idf), cell % len(idf)
    value = times * idf[which]
    norm = np.sqrt(np.bincount(window, value * value))
    return window, which, value / norm[window]


def row_products(window: np.ndarray, which: np.ndarray, value: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature * features + other feature, product) for any two entries of a window, the smaller feature first."""
    keys, sums = [which * features + which], [value * value]
    at, k = np.arange(len(which)), 1
    while len(at):
        at = at[at + k < len(which)]
        at = at[window[at + k] == window[at]]
        keys.append(which[at] * features + which[at + k])
        sums.append(value[at] * value[at + k])
        k += 1
    return np.concatenate(keys), np.concatenate(sums)


def summed_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


def passage_products(numbers: DataFrame, feature: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(feature, other, value): the features from this one on that share a passage with it, itself first, and the
    sums of products over all passages of all documents, as a stored table."""
    features = len(idf)
    size = numbers.agg(F.sum(F.octet_length("ids")).alias("n")).first()["n"] or 0
    together = numbers.select("ids").coalesce(max(1, -(-size // ADDED_BYTES)))
    shared = numbers.sparkSession.sparkContext.broadcast((feature, idf))

    def rows_of(keys, values):
        which, first = np.unique(keys // features, return_index=True)
        edge = pa.array(np.append(first, len(keys)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.ListArray.from_arrays(edge, pa.array((keys % features).astype(np.int32))),
             pa.ListArray.from_arrays(edge, pa.array(values))], names=["feature", "other", "value"])

    def multiply(batches):
        known, weight = shared.value
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES, "ids"):
                more, sums = row_products(*passage_rows(numbers_in(part), known, weight), features)
                keys.append(more)
                values.append(sums)
                if sum(map(len, keys)) > 2 * HELD:
                    held, sums = summed_by(np.concatenate(keys), np.concatenate(values))
                    if len(held) > HELD:
                        yield rows_of(held, sums)
                        held, sums = held[:0], sums[:0]
                    keys, values = [held], [sums]
        yield rows_of(*summed_by(np.concatenate(keys), np.concatenate(values)))

    def added(pdf):
        import pandas as pd

        other, value = summed_by(np.concatenate(list(pdf["other"])), np.concatenate(list(pdf["value"])))
        return pd.DataFrame({"feature": [int(pdf["feature"].iloc[0])], "other": [other], "value": [value]})

    kind = "feature long, other array<int>, value array<double>"
    # a group has a row of at most so many entries as features each time that a task adds up
    return stored(together.mapInArrow(tidy(multiply), kind).groupBy("feature").applyInPandas(added, kind), "latent-products")


def lcs_length(masks: dict[str, int], size: int, window: list[str]) -> int:
    """Length of the longest common subsequence, 1 bit per word of the item."""
    row = (1 << size) - 1
    for mask in map(masks.get, window):
        if mask:
            both = row & mask
            row = (row + both) | (row - both)
    return size - (row & ((1 << size) - 1)).bit_count()


def run_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the runs of RUN known words (ids of at least 0)."""
    if len(ids) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids, RUN).min(axis=1) >= 0)
    keys = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        keys = mixed(keys + ids[at + k].astype(np.uint64) + np.uint64(1))
    return at, keys


class Search:
    def __init__(self, parts, place, idf, basis):
        self.parts = parts
        self.vectors = (idf[:, None] * basis).astype(np.float32)
        rows = np.stack([self.vectors[counts_of(p.words, place)[1]].sum(axis=0) for p in parts])
        self.items = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).T.copy()
        self.known = {w: i for i, w in enumerate(vocabulary_of(parts))}
        self.masks, self.answers = [], []
        for p in parts:
            m: dict[int, int] = {}
            for i, w in enumerate(self.ids(p.words).tolist()):
                m[w] = m.get(w, 0) | 1 << i
            self.masks.append(m)
            self.answers.append(self.ids(p.answer).tolist())
        self.short = np.flatnonzero([len(p.words) <= STRIDE for p in parts])
        self.feature = feature_numbers(list(self.known), place)
        # which words each part has; the last column is for words of no part
        self.has = np.zeros((len(parts), len(self.known) + 1), bool)
        for i, p in enumerate(parts):
            self.has[i, self.ids(p.words)] = True
        self.size = np.array([len(p.words) for p in parts])
        runs = [run_keys(self.ids(p.words)) for p in parts]
        keys = np.concatenate([key for _, key in runs])
        order = np.argsort(keys, kind="stable")
        self.run_key = keys[order]
        self.run_part = np.repeat(np.arange(len(parts)), [len(at) for at, _ in runs])[order]
        self.run_at = np.concatenate([at for at, _ in runs])[order]

    def ids(self, words: list[str]) -> np.ndarray:
        return numbers_of(words, self.known).astype(np.int64)

    def runs(self, ids: np.ndarray, begin: np.ndarray):
        """(first word of a window, part) around each run of words that a part has as well."""
        at, keys = run_keys(ids)
        low, high = np.searchsorted(self.run_key, keys), np.searchsorted(self.run_key, keys, "right")
        met = set()
        for i in np.flatnonzero(high > low):
            first = int(begin[np.searchsorted(begin, at[i], "right") - 1])
            for j in range(low[i], high[i]):
                part = int(self.run_part[j])
                before = (WINDOW - len(self.parts[part].words)) // 2
                met.add((max(first, int(at[i] - self.run_at[j]) - before), part))
        return sorted(met)

    def cosine_of(self, window: list[int], part: int) -> float:
        which = self.feature[window]
        row = self.vectors[which[which >= 0]].sum(axis=0)
        return float(row @ self.items[:, part] / max(np.linalg.norm(row), 1e-12))

    def candidates(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of first words of windows, parts, cosines."""
        found = self.feature[ids]
        at = np.flatnonzero(found >= 0)
        which = found[at]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        blocks, first = np.unique(at // STRIDE, return_index=True)
        sums = np.add.reduceat(self.vectors[which], first, axis=0)
        spread = WINDOW // STRIDE
        starts = np.unique(np.concatenate([np.maximum(blocks - k, 0) for k in range(spread)]))
        # windows begin inside texts, none in the blank blocks before one
        size = np.diff(np.append(begin, len(ids))) - WINDOW
        text = np.searchsorted(begin, starts * STRIDE, "right") - 1
        starts = starts[starts * STRIDE - begin[text] < np.maximum(size[text], 1)]
        rows = np.zeros((len(starts), sums.shape[1]), np.float32)
        near = []
        for k in range(spread):
            where = np.minimum(np.searchsorted(blocks, starts + k), len(blocks) - 1)
            held = blocks[where] == starts + k
            if k == spread - 1 and len(self.short):
                near.append(self.near(rows, starts, self.short))
            rows[held] += sums[where[held]]
        near.append(self.near(rows, starts, np.arange(len(self.parts))))
        start, part, cosine = (np.concatenate(x) for x in zip(*near, strict=True))
        return start, part, cosine

    def near(self, rows, starts, parts):
        cosine = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12) @ self.items[:, parts]
        i, k = np.nonzero(cosine >= COSINE)
        return starts[i] * STRIDE, parts[k], cosine[i, k]

    def matches(self, words: list[np.ndarray]) -> list[dict[int, tuple]]:
        """For each text (word numbers), item: (first word, cosine, lcs, answer) of the best window of each item found.

        The texts are laid one behind the other, each at a whole block and with a window of blank
        places behind it, so that one pass serves all and no window holds words of two.
        """
        blocks = [-(-len(w) // STRIDE) * STRIDE + WINDOW for w in words]
        begin = np.cumsum([0, *blocks])[:-1]
        ids = np.full(int(sum(blocks)), -1, np.int64)
        for at, w in zip(begin.tolist(), words, strict=True):
            ids[at:at + len(w)] = w
        best: list[dict[int, tuple]] = [{} for _ in words]
        for start, k, cosine in self.reachable(ids, *self.candidates(ids, begin)):
            text = int(np.searchsorted(begin, start, "right")) - 1
            self.judge(words[text], start - int(begin[text]), k, cosine, best[text])
        for start, k in self.runs(ids, begin):
            text = int(np.searchsorted(begin, start, "right")) - 1
            if self.parts[k].item not in best[text]:
                self.judge(words[text], start - int(begin[text]), k, None, best[text])
        return [{i: (-f[3], f[2], f[0], f[1]) for i, f in b.items()} for b in best]

    def reachable(self, ids: np.ndarray, start: np.ndarray, part: np.ndarray, cosine: np.ndarray):
        """The candidates whose window has enough words of the part: a common subsequence has no others."""
        padded = np.concatenate([ids, np.full(WINDOW, -1)])
        words = padded[start[:, None] + np.arange(WINDOW)]
        enough = self.has[part[:, None], words].sum(axis=1) / self.size[part] >= LCS
        return zip(start[enough].tolist(), part[enough].tolist(), cosine[enough].tolist(), strict=True)

    def judge(self, words: np.ndarray, start: int, k: int, cosine: float | None, best: dict[int, tuple]) -> None:
        part = self.parts[k]
        window = words[start:start + WINDOW].tolist()
        share = lcs_length(self.masks[k], len(part.words), window) / len(part.words)
        if share < LCS:
            return
        held = set(window)
        answer = sum(w in held for w in self.answers[k]) / len(part.answer)
        if answer < ANSWER:
            return
        found = (share, answer, min(1.0, self.cosine_of(window, k) if cosine is None else cosine), -start)
        if part.item not in best or found > best[part.item]:
            best[part.item] = found


def part_matches(docs: DataFrame, rows: list[tuple[int, str]], total: int) -> DataFrame:
    spark = docs.sparkSession
    parts = parts_of(rows)
    if not parts:
        return spark.createDataFrame([], KEYED_MATCH)
    vocabulary = vocabulary_of(parts)
    numbers = numbered(docs, vocabulary)
    place, idf = chosen_features(parts, document_counts(numbers, vocabulary), total)
    own = []
    for p in parts:
        some, times = np.unique(counts_of(p.words, place)[1], return_counts=True)
        v = times * idf[some]
        own.append((some, v / np.linalg.norm(v)))
    products = passage_products(numbers, feature_numbers(vocabulary, place), idf)
    # the rows have length 1, so the products of features with themselves add up to the number of passages
    passages = products.agg(F.sum(F.col("value")[0]).alias("n")).first()["n"] or 0.0
    weight = max(1.0, (passages / len(own)) ** 0.5)
    basis = randomised_svd(products, own, weight, len(place))
    shared = spark.sparkContext.broadcast((parts, place, idf, basis.astype(np.float32)))

    def search(batches):
        finder = Search(*shared.value)
        for batch in batches:
            found = []
            for part in pieces_of(batch, BATCH_BYTES, "ids"):
                rows = zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), finder.matches(numbers_in(part)), strict=True)
                found += [(doc_id, item, *m, text_key) for doc_id, text_key, met in rows for item, m in sorted(met.items())]
            columns = list(zip(*found, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "word", "cosine", "lcs", "answer", "text_key"])

    return numbers.mapInArrow(tidy(search), KEYED_MATCH).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, word, cosine, lcs, answer."""
    return keyed_matches(docs, benchmark).where("doc_id is not null").drop("text_key").distinct()


def keyed_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The matches of all rows, with text_key, which tells rows of one doc_id or without one apart."""
    ship(docs.sparkSession)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")) \
        .where("item_id is not null and text is not null").distinct()
    total = docs.select(F.lit(1)).count()
    shares = max(1, -(-items.count() // ITEMS_TOGETHER))
    found = docs.sparkSession.createDataFrame([], KEYED_MATCH)
    for k in range(shares):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == k).orderBy("item_id", "text")
        found = found.unionByName(part_matches(docs, [(r["item_id"], r["text"]) for r in rows.toLocalIterator()], total))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item was found, with the columns of docs."""
    found = stored(keyed_matches(docs, benchmark).select(F.col("doc_id").alias("leaking"), "text_key").distinct(), "leaking")
    same = docs["doc_id"].cast("long").eqNullSafe(found["leaking"]) & (F.xxhash64(docs["text"].cast("string")) == found["text_key"])
    return docs.join(found, same, "left_anti")
