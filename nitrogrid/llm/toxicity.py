"""Toxicity grades by cumulative-link ordinal regression over words.

P(grade <= k) = sigmoid(cut_k - w.x): one weight per word is shared by all thresholds, the cuts are
ordered. x has a 1 for each vocabulary word in a passage. The passages of a text have PASSAGE words and
begin every STRIDE words; all are scored and the text has the severity of its worst passage, so what
stands around a passage takes nothing off it. The vocabulary is chosen by Spark over all
labelled rows: words whose share among toxic rows differs most from their share among clean ones.
The weights are fitted by gradient steps on a bounded sample of labelled rows (MOST_ROWS, in order
of a hash of the doc_id). As in scoring, the worst passage stands for the row: first by the leanings
of the words, then (ROUNDS) by the weights of the fit before. A word's leaning is the log ratio of its
counts in toxic and clean rows to the counts that its frequency alone gives, each with PRIOR_ROWS
added; a weight is shrunk the more the less its word leans, so rare words of clean rows weigh little.
The result is the expected grade, the severity. Rows are rejected from the lowest severity, REJECT_FROM
at most, at which PRECISION of the rejected labelled rows are toxic; for that, each half of the sample
is scored with the weights of the other half.

The labels give a flag only. Three grades are made of it: 0 for clean rows, and toxic rows are
split at the median number of toxic words (words at least LEAN times as frequent in toxic rows) per
distinct word of the worst passage into 1 and 2.

Defined cases: a null text is empty and has the grade that the cuts alone give. Labels without a
document, and null labels, are not used; without any labelled row of both kinds all severities are
0. Repeated rows are scored each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm import bitfilter
from nitrogrid.llm.common import id_and_text, mixed, ship, stored, texts, tidy

GRADES = 3
MOST_ROWS = 20_000
MOST_WORDS = 4_096
LEAST_ROWS_WITH_WORD = 3
LEAN = 8.0
REJECT_FROM = 0.5
PRECISION = 0.99
PASSAGE, STRIDE = 64, 32
ROUNDS = 2
PRIOR_ROWS, LEAST_LEANING = 10, 0.1
STEPS = 400
RATE = 0.3
DECAY = 1e-3
ROWS_OUT = 50_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    reject_from: float = REJECT_FROM

    def severity(self, found: list[str]) -> tuple[list[float], list[float]]:
        """Expected grade and probability of any grade above 0, per text."""
        score = np.array([worst_passage(words_of(t), self.words, self.weights)[0] for t in found])
        above = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))  # P(grade > k)
        return above.sum(axis=1).tolist(), above[:, 0].tolist()


def flagged(labels: DataFrame) -> DataFrame:
    """(labelled_id, toxic): one row per labelled document."""
    return labels.select(labels["doc_id"].cast("long").alias("labelled_id"), labels["toxic"].cast("int").alias("toxic")) \
        .where("labelled_id is not null and toxic in (0, 1)").groupBy("labelled_id").agg(F.max("toxic").alias("toxic"))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def distinct_words(text: str) -> set[str]:
    return set(words_of(text))


def worst_passage(words: list[str], place: dict[str, int], weights: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Score, first word and features of the passage with the highest score; of equal ones the first.

    A passage is PASSAGE // STRIDE blocks of STRIDE words, so a block is in so many passages.
    """
    spread = PASSAGE // STRIDE
    count = max(1, -(-len(words) // STRIDE) - spread + 1)
    found = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
    at = np.flatnonzero(found >= 0)
    passage = (at[:, None] // STRIDE - np.arange(spread)).ravel()
    keys = (passage * len(weights) + np.repeat(found[at], spread))[(passage >= 0) & (passage < count)]
    passage, feature = np.divmod(np.unique(keys), max(1, len(weights)))
    scores = np.bincount(passage, weights[feature], count)
    worst = int(scores.argmax())
    return float(scores[worst]), worst * STRIDE, feature[passage == worst]


def word_counts(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(word, bad, good): in how many toxic and clean labelled rows each word stands.

    A task counts all its rows before anything is shuffled. The empty word stands for every row.
    """
    rows = bitfilter.rows_near(id_and_text(docs), "doc_id", flags, "labelled_id")
    rows = rows.join(flags.hint("merge"), rows["doc_id"] == flags["labelled_id"]).select("toxic", "text")

    def count(batches):
        met = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
                met[toxic].update(distinct_words(text))
                met[toxic][""] += 1
        words = list(met[0].keys() | met[1].keys())
        for at in range(0, len(words), ROWS_OUT):
            some = words[at:at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), *(pa.array([met[k][w] for w in some], pa.int64()) for k in (1, 0))],
                names=["word", "bad", "good"])

    counted = rows.mapInArrow(tidy(count), "word string, bad long, good long")
    return counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def vocabulary(counts: DataFrame, most: int = MOST_WORDS) -> tuple[dict[str, float], set[str]]:
    """The words of the model with their leanings, and those that are LEAN times as frequent in toxic rows."""
    totals = counts.where("word = ''").first()
    bad, good = (totals["bad"], totals["good"]) if totals else (0, 0)
    if not bad or not good:
        return {}, set()
    share_bad = (F.col("bad") + 0.5) / (bad + 1)
    share_good = (F.col("good") + 0.5) / (good + 1)
    pooled = (F.col("bad") + F.col("good")) / (bad + good)
    judged = (
        counts.where((F.col("word") != "") & (F.col("bad") + F.col("good") >= LEAST_ROWS_WITH_WORD))
        .withColumn("ratio", share_bad / share_good)
        .withColumn("strength", F.abs(F.col("bad") / bad - F.col("good") / good) / F.sqrt(pooled * (1 - pooled) + 1e-9))
    )
    chosen = judged.orderBy(F.desc("strength"), "word").limit(most).select("word", "ratio", "bad", "good").collect()

    def leaning(n_bad, n_good):
        usual = (n_bad + n_good) * bad / (bad + good)
        return float(np.log((n_bad + PRIOR_ROWS) / (usual + PRIOR_ROWS))
                     - np.log((n_good + PRIOR_ROWS) / (n_bad + n_good - usual + PRIOR_ROWS)))

    return {r["word"]: leaning(r["bad"], r["good"]) for r in chosen}, {r["word"] for r in chosen if r["ratio"] >= LEAN}


def fit_cumulative(indices: list[np.ndarray], grades: np.ndarray, features: int, grade_count: int = GRADES,
                   steps: int = STEPS, decay: float | np.ndarray = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that maximise the likelihood, by adaptive full-batch steps.

    The cuts are the first one plus positive gaps, so they stay ordered.
    """
    n = len(indices)
    row = np.repeat(np.arange(n), [len(i) for i in indices])
    column = np.concatenate(indices) if n else np.zeros(0, np.int64)
    share = np.clip(np.array([(grades <= k).mean() for k in range(grade_count - 1)]), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grade_count - 1))
    free = np.append(start[:1], np.log(np.maximum(np.diff(start), 1e-2)))
    weights = np.zeros(features)
    sum_w, sum_c = np.full(features, 1e-8), np.full(grade_count - 1, 1e-8)
    for _ in range(steps):
        cuts = np.cumsum(np.append(free[:1], np.exp(free[1:])))
        score = np.bincount(row, weights[column], n)
        edges = np.concatenate([np.full((n, 1), -np.inf), cuts[None, :] - score[:, None], np.full((n, 1), np.inf)], axis=1)
        below = 1 / (1 + np.exp(-np.clip(edges, -40, 40)))
        below[:, 0], below[:, -1] = 0, 1
        slope = below * (1 - below)
        at = np.arange(n)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        d_high, d_low = slope[at, grades + 1] / p, slope[at, grades] / p
        g_score = (d_high - d_low) / n  # d loss / d score
        g_cut = np.zeros(grade_count - 1)
        for k in range(grade_count - 1):
            g_cut[k] = (-(d_high * (grades == k)) + d_low * (grades == k + 1)).sum() / n
        g_free = np.append(g_cut.sum(), [g_cut[k:].sum() * np.exp(free[k]) for k in range(1, grade_count - 1)])
        g_w = np.bincount(column, g_score[row], features) + decay * weights
        sum_w += g_w ** 2
        sum_c += g_free ** 2
        weights -= RATE * g_w / np.sqrt(sum_w)
        free -= RATE * g_free / np.sqrt(sum_c)
    return weights, np.cumsum(np.append(free[:1], np.exp(free[1:])))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    flags = stored(flagged(labels), "toxicity-labels")
    leanings, toxic_words = vocabulary(stored(word_counts(docs, flags), "toxicity-words"))
    if not leanings:
        return Model({}, np.zeros(0), np.full(GRADES - 1, 50.0))
    place = {w: i for i, w in enumerate(leanings)}
    weights = np.array(list(leanings.values()))
    decay = DECAY / np.maximum(np.abs(weights), LEAST_LEANING) ** 2

    # at most most_rows labels go to all tasks; the texts stay where they are
    sample = flags.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most_rows)
    rows = id_and_text(docs)
    rows = stored(rows.join(F.broadcast(sample), rows["doc_id"] == sample["labelled_id"]).select("doc_id", "toxic", "text"),
                  "toxicity-sample")
    for _ in range(ROUNDS):
        half, features, grades = worst_passages(rows, place, toxic_words, weights)
        weights, cuts = fit_cumulative(features, grades, len(place), decay=decay)
    judges = []
    for k in (1, 0):
        some = np.flatnonzero(half == k)
        judges.append(Model(place, *fit_cumulative([features[i] for i in some], grades[some], len(place), decay=decay)))
    return Model(place, weights, cuts, rejection_limit(*held_out(rows, judges)))


def halves(doc_ids: np.ndarray) -> np.ndarray:
    return (mixed(doc_ids.astype(np.int64).view(np.uint64)) & np.uint64(1)).astype(np.int64)


def held_out(rows: DataFrame, judges: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Severity, by the model fitted without its half, and flag of each row (doc_id, toxic, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(judges)

    def score(batches):
        for batch in batches:
            found, half = texts(batch), halves(batch.column("doc_id").to_numpy())
            severity = np.zeros(len(found))
            for k in (0, 1):
                at = np.flatnonzero(half == k)
                severity[at] = shared.value[k].severity([found[i] for i in at])[0]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(severity, pa.float64())], names=["toxic", "severity"])

    judged = rows.mapInArrow(tidy(score), "toxic int, severity double").toPandas()
    return judged["severity"].to_numpy(), judged["toxic"].to_numpy()


def rejection_limit(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The lowest severity from which on PRECISION of the rows are toxic, and REJECT_FROM at most."""
    order = np.argsort(-severity, kind="stable")
    severity, right = severity[order], np.cumsum(toxic[order])
    last = np.append(severity[1:] != severity[:-1], True)  # equal severities are rejected together
    good = np.flatnonzero(last & (right >= PRECISION * np.arange(1, len(right) + 1)))
    return float(min(severity[good[-1]], REJECT_FROM)) if len(good) else REJECT_FROM


def worst_passages(rows: DataFrame, place: dict[str, int], toxic_words: set[str],
                   weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Half, and features and grade of the worst passage, of each row (doc_id, toxic, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((place, toxic_words, weights))

    def encode(batches):
        known, lean, weight = shared.value
        for batch in batches:
            features, density = [], []
            for text in texts(batch):
                words = words_of(text)
                _, first, feature = worst_passage(words, known, weight)
                some = set(words[first:first + PASSAGE])
                features.append(feature)
                density.append(sum(w in lean for w in some) / max(1, len(some)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array(features, pa.list_(pa.int32())),
                pa.array(density, pa.float64()),
            ], names=["doc_id", "toxic", "features", "density"])

    encoded = rows.mapInArrow(tidy(encode), "doc_id long, toxic int, features array<int>, density double").toPandas()
    encoded = encoded.sort_values(["doc_id", "density"])
    toxic = encoded["toxic"].to_numpy()
    density = encoded["density"].to_numpy()
    half = np.median(density[toxic == 1]) if (toxic == 1).any() else 0.0
    grades = np.where(toxic == 0, 0, np.where(density > half, 2, 1))
    return halves(encoded["doc_id"].to_numpy()), [np.asarray(f, np.int64) for f in encoded["features"]], grades


def graded(docs: DataFrame, model: Model, reject_from: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, severity, p_toxic, grade, rejected."""
    reject_from = model.reject_from if reject_from is None else reject_from
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            severity, above = shared.value.severity(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(severity, pa.float64()), pa.array(above, pa.float64()),
                 pa.array([round(s) for s in severity], pa.int32()), pa.array([s >= reject_from for s in severity], pa.bool_())],
                names=["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return id_and_text(docs).mapInArrow(tidy(score), "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def without_toxic(docs: DataFrame, model: Model, reject_from: float | None = None) -> DataFrame:
    """The rows of docs whose severity is below the limit, with the columns of docs. Nothing shuffles."""
    reject_from = model.reject_from if reject_from is None else reject_from
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        severity, _ = shared.value.severity([t or "" for t in text])
        return pd.Series([s < reject_from for s in severity], dtype=bool)

    return docs.where(clean(docs["text"].cast("string")))
