"""Language identification by a linear-chain conditional random field over words.

Each word has a state, its language. Features of a word are its affixes, its character n-grams and
a lexicon value: how the word's hash bucket leans to each language over all training rows, counted
by Spark into a table of fixed size. Transitions are learned from runs of words of several
languages put one after another. A text's words are labelled by forward-backward, exactly and over
the whole text: blocks of words are multiplied into matrices, the matrices are chained per text,
and the chain is carried back into the blocks. The text's language has the largest mean
probability over its words; that mean is the score.

The lexicon is counted over every training row. The weights are fitted on a bounded sample of them:
SAMPLE_ROWS rows, in order of a hash of the doc_id, RUN words at a place of each.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when
there is no training row. A row whose doc_id is null is held out. Repeated rows are labelled each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm.common import id_and_text, mixed, pieces_of, ship, texts
from nitrogrid.llm.textarrays import BASE, range_hash

HELD_OUT = 2
FOLDS = 4
BUCKETS = 1 << 16
LEXICON = 1 << 16
SAMPLE_ROWS = 3_000
RUN = 12
RUNS_TOGETHER = 4
STEPS = 40
RATE = 0.5
BLOCK = 32
BATCH_BYTES = 8 << 20
CACHED = 300_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words, each with a mark before and after it, and where each word begins."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.astype(np.uint64), start


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams and affixes: (feature, number of its word), and how many each word has."""
    flat, start = characters(words)
    size = np.diff(start)
    number = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start[1:], size) - np.arange(len(flat))  # characters from here to the word's end
    found, owner = [], []
    gram = np.zeros(len(flat), np.uint64)
    for k in range(1, 5):
        shifted = np.concatenate([flat[k - 1:], np.zeros(min(k - 1, len(flat)), np.uint64)])[:len(flat)]
        gram = mixed(gram * BASE + shifted + np.uint64(k))
        whole = left >= k
        if k <= 3:
            found.append(gram[whole])
            owner.append(number[whole])
        if k >= 2:  # affixes of one to three characters and the mark
            has = np.flatnonzero(size > k)
            for salt, place in ((101, start[has]), (202, start[has + 1] - k)):
                found.append(mixed(gram[place] + np.uint64(salt)))
                owner.append(has)
    owner = np.concatenate(owner)
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), owner, np.bincount(owner, minlength=len(words))


def buckets(words: list[str]) -> np.ndarray:
    """The lexicon bucket of each word."""
    flat, start = characters(words)
    return (mixed(range_hash(flat, start[:-1], start[1:])) % np.uint64(LEXICON)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # BUCKETS x languages
    lexicon: np.ndarray      # LEXICON x languages: log share of the bucket against the language's share
    lean: float              # weight of the lexicon
    transitions: np.ndarray  # languages x languages

    def emissions(self, words: list[str]) -> np.ndarray:
        feature, owner, sizes = features(words)
        total = np.stack([np.bincount(owner, self.weights[feature, k], len(words)) for k in range(len(self.languages))], 1)
        return total / sizes[:, None] + self.lean * self.lexicon[buckets(words)]


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """The probability of each state of each word, for texts of the given numbers of words (all > 0).

    With pairs also the forward values and the backward values times the word's own: their outer
    product times the transitions is proportional to the probability of two neighbours' states.
    """
    states = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    blocks = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    n = int(first_block[-1])
    # words into blocks; places after a text's end are marked as absent
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(len(scores)) - np.repeat(start, sizes)
    row = np.repeat(first_block[:-1], sizes) + within // BLOCK
    column = within % BLOCK
    table = np.ones((BLOCK, n, states))
    table[column, row] = emit
    present = np.zeros((BLOCK, n), bool)
    present[column, row] = True

    def normal(x, axes):
        return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(states), (n, states, states)).copy()
    for t in range(BLOCK):
        on = present[t]
        moved = np.matmul(product[on], step) * table[t, on][:, None, :]
        product[on] = normal(moved, (1, 2))
    # chain the blocks of each text, longest texts first
    order = np.argsort(-blocks, kind="stable")
    head, count = first_block[:-1][order], blocks[order]
    into = np.full((n, states), 1.0 / states)
    after = np.ones((n, states))
    for j in range(1, int(count[0])):
        on = head[:np.searchsorted(-count, -j, side="left")] + j
        into[on] = normal(np.einsum("bi,bij->bj", into[on - 1], product[on - 1]), 1)
    for j in range(int(count[0]) - 2, -1, -1):
        on = head[:np.searchsorted(-count, -(j + 1), side="left")] + j
        after[on] = normal(np.einsum("bij,bj->bi", product[on + 1], after[on + 1]), 1)
    forward = np.empty((BLOCK, n, states))
    at = into
    for t in range(BLOCK):
        moved = normal(at @ step * table[t], 1)
        at = np.where(present[t][:, None], moved, at)
        forward[t] = at
    back = after
    if pairs:
        alpha, gain = forward[column, row], np.empty_like(forward)
    for t in range(BLOCK - 1, -1, -1):
        if pairs:
            gain[t] = back * table[t]
        forward[t] = normal(forward[t] * back, 1)
        moved = normal((back * table[t]) @ step.T, 1)
        back = np.where(present[t][:, None], moved, back)
    if pairs:
        return forward[column, row], alpha, gain[column, row]
    return forward[column, row]


def fit_weights(sequences: list[list[str]], states: list[list[int]], languages: list[str], lexicon: np.ndarray) -> Model:
    """Maximum likelihood by adaptive full-batch steps; the gradient is counts minus expectations."""
    count = len(languages)
    model = Model(languages, np.zeros((BUCKETS, count)), lexicon, 0.5, np.zeros((count, count)))
    if not sequences or count < 2:
        return model
    sizes = np.array([len(s) for s in sequences])
    flat = [w for s in sequences for w in s]
    known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    which = np.array([known[w] for w in flat])
    feature, word_of, lengths = features(list(known))
    share = 1.0 / lengths
    used, slot = np.unique(feature, return_inverse=True)
    lexical = lexicon[buckets(list(known))]
    gold = np.array([y for s in states for y in s])
    hot = np.eye(count)[gold]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((count, count))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1.0)
    total_w, total_t, total_l = np.full((len(used), count), 1e-6), np.full((count, count), 1e-6), 1e-6
    weights = np.zeros((len(used), count))
    for _ in range(STEPS):
        mean = np.stack([np.bincount(word_of, weights[slot, k], len(known)) for k in range(count)], 1) * share[:, None]
        scores = (mean + model.lean * lexical)[which]
        p, alpha, gain = forward_backward(scores, sizes, model.transitions, pairs=True)
        off = (hot - p) / len(flat)
        by_word = np.stack([np.bincount(which, off[:, k], len(known)) for k in range(count)], 1)
        spread = by_word * share[:, None]
        g_w = np.stack([np.bincount(slot, spread[word_of, k], len(used)) for k in range(count)], 1) - 1e-6 * weights
        g_l = float((by_word * lexical).sum())
        step = np.exp(model.transitions - model.transitions.max())
        pair = alpha[inner - 1][:, :, None] * step[None] * gain[inner][:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
        g_t = (seen - pair.sum(axis=0)) / len(flat) - 1e-4 * model.transitions
        total_w += g_w ** 2
        total_t += g_t ** 2
        total_l += g_l ** 2
        weights += RATE * 4 * g_w / np.sqrt(total_w)
        model.transitions = model.transitions + RATE * 0.5 * g_t / np.sqrt(total_t)
        model.lean += RATE * 0.2 * g_l / np.sqrt(total_l)
    model.weights[used] = weights
    return model


def with_fold(docs: DataFrame) -> DataFrame:
    rows = id_and_text(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))
    return rows.withColumn("held_out", held)


def training_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows that may be learned from."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       docs["lang"].cast("string").alias("lang"))
    return rows.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))


def lexicon_table(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """How each bucket of words leans to each language, counted over all training rows."""
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        met = np.zeros((len(place), LEXICON), np.int64)
        known: dict[str, int] = {}
        for batch in batches:
            found = [words_of(t) for t in texts(batch)]
            if len(known) > CACHED:
                known.clear()
            new = sorted(set().union(*found) - known.keys())
            known.update(zip(new, buckets(new).tolist(), strict=True))
            get = known.__getitem__
            lang = batch.column("lang").to_pylist()
            for name in set(lang):
                flat = [i for words, at in zip(found, lang, strict=True) if at == name for i in map(get, words)]
                met[place[name]] += np.bincount(np.array(flat, np.int64), minlength=LEXICON)
        met = met.T
        b, k = np.nonzero(met)
        yield pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(met[b, k], pa.int64())], names=["bucket", "language", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "bucket long, language long, n long") \
        .groupBy("bucket", "language").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((LEXICON, len(languages)))
    table[counted["bucket"], counted["language"]] = counted["n"]
    share = (table + 0.1) / (table.sum(axis=0, keepdims=True) + 0.1 * LEXICON)
    log = np.log(share)
    return np.clip(log - log.mean(axis=1, keepdims=True), -4, 4)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = training_rows(docs)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((LEXICON, 0)), 0.0, np.zeros((0, 0)))
    lexicon = lexicon_table(rows, languages)

    def runs(batches):
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = [w for w in words_of(text) if has_letter(w)]
                at = int(mixed(np.array([doc_id], np.int64).view(np.uint64))[0] % np.uint64(max(1, len(words) - RUN)))
                found.append(words[at:at + RUN])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.string()))],
                names=["doc_id", "lang", "words"])

    chosen = rows.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = chosen.select(F.col("doc_id").alias("picked")).distinct()
    sample = rows.join(F.broadcast(picked), rows["doc_id"] == F.col("picked"), "left_semi")
    sample = sample.mapInArrow(runs, "doc_id long, lang string, words array<string>") \
        .orderBy(F.xxhash64("doc_id", "lang"), "doc_id").toPandas()
    place = {name: i for i, name in enumerate(languages)}
    sequences, states = [], []
    pairs = [(list(w), place[k]) for w, k in zip(sample["words"], sample["lang"], strict=True) if len(w)]
    for at in range(0, len(pairs), RUNS_TOGETHER):
        some = pairs[at:at + RUNS_TOGETHER]
        sequences.append([w for ws, _ in some for w in ws])
        states.append([k for ws, k in some for _ in ws])
    return fit_weights(sequences, states, languages, lexicon)


class Labeller:
    """Labels texts with a model; scores of words are kept while there are not too many."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def word_scores(self, words: list[list[str]]) -> list[list[int]]:
        if len(self.place) > CACHED:
            self.place, self.scores = {}, self.scores[:0]
        new = sorted(set().union(*words) - self.place.keys())
        letters = [w for w in new if has_letter(w)]
        self.place.update((w, -1) for w in new)
        if letters:
            self.place.update(zip(letters, range(len(self.scores), len(self.scores) + len(letters)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.emissions(letters)])
        get = self.place.__getitem__
        return [list(map(get, w)) for w in words]

    def label(self, found: list[str]) -> tuple[list[str], list[float]]:
        names, score = [UNKNOWN] * len(found), [0.0] * len(found)
        if not self.model.languages:
            return names, score
        rows = self.word_scores([words_of(t) for t in found])
        rows = [np.array(r, np.int64) for r in rows]
        rows = [r[r >= 0] for r in rows]
        sizes = np.array([len(r) for r in rows])
        on = np.flatnonzero(sizes)
        if len(on):
            flat = np.concatenate([rows[i] for i in on])
            p = forward_backward(self.scores[flat], sizes[on], self.model.transitions)
            ends = np.concatenate([[0], np.cumsum(sizes[on])[:-1]])
            mean = np.add.reduceat(p, ends, axis=0) / sizes[on][:, None]
            best = mean.argmax(axis=1)
            for i, k, m in zip(on.tolist(), best.tolist(), mean[np.arange(len(on)), best].tolist(), strict=True):
                names[i], score[i] = self.model.languages[k], min(1.0, m)
        return names, score


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        labeller = Labeller(shared.value)
        for whole in batches:
            for batch in pieces_of(whole, BATCH_BYTES):
                names, score = labeller.label(texts(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return with_fold(docs).mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def word_labels(model: Model, text: str) -> list[tuple[str, str]]:
    """The most probable language of each word of one text."""
    words = [w for w in words_of(text) if has_letter(w)]
    if not words or not model.languages:
        return []
    p = forward_backward(model.emissions(words), np.array([len(words)]), model.transitions)
    return [(w, model.languages[k]) for w, k in zip(words, p.argmax(axis=1).tolist(), strict=True)]
