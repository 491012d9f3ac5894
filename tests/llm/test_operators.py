"""The text operators against brute force, on ordinary and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitrogrid.llm import (
    bitfilter, components, decontamination, exact_dedup, language_id, license_scan, near_dedup, packing,
    substring_dedup, suffix_dedup, token_counts, toxicity,
)
from nitrogrid.llm.common import documents, work_path
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts_of(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark, SF).collect()]


# 1 license scan

def brute_places(text):
    words = license_scan.words_of(text or "")
    found = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return words, found


def brute_labels(words):
    found, best = set(), 0.0
    for t in license_scan.templates():
        if not t.phrase:
            for s in range(0, len(words), license_scan.STRIDE):
                width = max(license_scan.BLOCK, license_scan.STRIDE * (1 + -(-len(t.words) // license_scan.STRIDE)))
                n = len(set(words[s:s + width]) & set(t.tokens))
                if n >= t.need:
                    found.add(t.label)
                    best = max(best, n / len(t.tokens))
    return found, best


def test_license_places(spark, odd_rows):
    rows = [*odd_rows, (70, "CC BY, CC-by cc by! All RIGHTS reserved", "en"), (71, "w " * 47 + "all rights reserved " * 3, "en"),
            (72, "w " * 23 + "general public license", "en"),
            (73, "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "en"),
            (74, "licensed under the apache license version", "en")]
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_blocks(frame(spark, rows)).collect()}
    for doc_id, text, _ in rows:
        words, places = brute_places(text)
        labels, best = brute_labels(words)
        r = got[doc_id, len(words)]
        assert r["n_base"] == len(places)
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        base = {x for _, x in places}
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | labels))
        assert r["score"] == (1.0 if base else best)


def test_license_texts_of_any_length(spark):
    """Whole notices at any place, with up to a fifth of their words changed; the blocks that meet them."""
    rng = random.Random(21)
    known = [t for t in license_scan.templates() if not t.phrase]
    assert max(len(t.words) for t in known) > 3 * license_scan.STRIDE
    own = " ".join(f"clause{k}" for k in range(400))
    rows = [(0, f"w {own} w", "en"), (1, None, "en"), (2, "", "en"), (None, own, "en")]
    for i in range(120):
        words = list(rng.choice(known).words)
        for k in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.1, 0.2, 0.3]))):
            words[k] = f"x{rng.randrange(50)}"
        rows.append((10 + i, " ".join(["w"] * rng.randrange(200) + words + ["v"] * rng.randrange(60)), "en"))
    further = {**license_scan.TEMPLATES, **license_scan.BODIES, own: "own"}
    got = license_scan.template_blocks(frame(spark, rows), further=further).collect()
    want = []
    for doc_id, text, _ in rows:
        words = license_scan.words_of(text or "")
        for t in license_scan.templates(further=further):
            width = max(license_scan.BLOCK, license_scan.STRIDE * (1 + -(-len(t.words) // license_scan.STRIDE)))
            for s in range(0, 0 if t.phrase else len(words), license_scan.STRIDE):
                n = len(set(words[s:s + width]) & set(t.tokens))
                if n >= t.need:
                    want.append((doc_id, t.label, " ".join(t.words), s, min(width, len(words) - s), n, n / len(t.tokens)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {0, None} <= {r["doc_id"] for r in got if r["label"] == "own" and r["containment"] == 1}
    # a whole notice lies in one block wherever it begins
    rows = [(100 * k + offset, " ".join(["w"] * offset + t.words), "en") for k, t in enumerate(known) for offset in range(0, 60, 7)]
    whole = license_scan.template_blocks(frame(spark, rows)).where("containment = 1").collect()
    assert {(i, t) for i, t, *_ in rows} <= {(r["doc_id"], " ".join(["w"] * (r["doc_id"] % 100)) + " " * (r["doc_id"] % 100 > 0) + r["template"])
                                             for r in whole}
    with pytest.raises(ValueError):
        license_scan.templates(further={"--": "none"})


# 2 and 9 substrings

def brute_repeats(rows, cut, join, width):
    seen, result = {}, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        symbols = cut(text or "")
        gone = bytearray(len(symbols))
        if doc_id is not None and text is not None:
            for s in range(len(symbols) - width + 1):
                k = tuple(symbols[s:s + width])
                if seen.setdefault(k, (doc_id, s)) < (doc_id, s):
                    gone[s:s + width] = b"\1" * width
        kept = join([x for x, g in zip(symbols, gone) if not g])
        result.append((doc_id, len(symbols), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return result


def stringy(rng, alphabet, n):
    rows = []
    for i in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 500)))
        if i % 5 == 0:
            t = "a" * rng.randint(0, 300) + t + "b c " * rng.randint(0, 100)
        if i and i % 2:
            v = rows[rng.randrange(i)][1]
            k = rng.randrange(len(v) + 1)
            t = t[:140] + v[k:k + rng.randint(0, 400)] + t[140:]
        rows.append((i, t, "en"))
    return rows


@pytest.fixture(scope="module", params=["odd", "strings"])
def repeat_rows(request, odd_rows):
    return odd_rows if request.param == "odd" else stringy(random.Random(2), "ab é\n", 80)


def test_substring_dedup(spark, repeat_rows):
    want = brute_repeats(repeat_rows, WORD.findall, lambda x: " ".join(x).encode(), 20)
    got = substring_dedup.without_repeats(frame(spark, repeat_rows))
    assert by_row(got) == sorted(((d, n, k, h) for d, n, k, _, h in want), key=repr)
    assert sum(w[2] for w in want) > 0


def test_suffix_dedup(spark, repeat_rows):
    want = brute_repeats(repeat_rows, lambda t: t.encode(), bytes, 100)
    assert by_row(suffix_dedup.without_repeats(frame(spark, repeat_rows))) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 3)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(130)) + passage + f"{i:03d}" * 30, "en") for i in range(40)]
    want = brute_repeats(rows, lambda t: t.encode(), bytes, 100)
    assert by_row(suffix_dedup.without_repeats(frame(spark, rows))) == sorted(want, key=repr)


def test_columns():
    """Order and common prefixes of the suffixes from each column, against sorting."""
    rng = random.Random(5)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\xe2") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        lead = np.array([rng.randrange(len(s)) for s in strings])
        for column, order, common in suffix_dedup.columns(strings, lead):
            at = {i: column + int(lead[i]) for i in order.tolist()}
            got = [i for i in order.tolist() if at[i] >= 0]
            reach = [i for i, s in enumerate(strings) if 0 <= column + lead[i] < len(s)]
            assert sorted(got) == reach
            suffix = {i: strings[i][at[i]:] for i in got}
            assert all(suffix[a] == suffix[b] or [*(x + 1 for x in suffix[a]), 0] < [*(x + 1 for x in suffix[b]), 0]
                       for a, b in zip(got, got[1:]))
            place = {i: k for k, i in enumerate(order.tolist())}
            for a, b in zip(got, got[1:]):
                n = next((j for j, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
                assert common[place[b]] == n


# 3 near duplicates

def brute_classes(rows, similar=near_dedup.SIMILAR):
    sets = {}
    for doc_id, text, _ in rows:
        w = WORD.findall(text or "")
        sets[doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if n >= similar * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def test_near_classes(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    want = brute_classes(rows)
    got = near_dedup.near_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    size = Counter(want[i] for i, _, _ in rows)
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def test_near_classes_of_chains_and_common_passages(spark):
    """A chain links its ends; texts that share half of their words with all others stay apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text, rows = [word() for _ in range(100)], []
    for k in range(25):
        text = [*text[:4 * k], *(word() for _ in range(3)), *text[4 * k + 3:]] if k else text
        rows.append((k, " ".join(text), "en"))
    common = [word() for _ in range(80)]
    rows += [(100 + k, " ".join([word() for _ in range(30)] + common + [word() for _ in range(30)]), "en") for k in range(40)]
    want = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_rows_without_id_meet_their_own_set(spark, odd):
    got = near_dedup.near_classes(odd).where("doc_id is null").collect()
    assert len(got) == 2 and sorted(r["class_id"] or 0 for r in got)[1] == 10


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    a[:40], b[-40:] = 0, 0
    both = np.flatnonzero((a > 0) & (b > 0))
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    sa, sb = (near_dedup.signatures(ids[w > 0], w[w > 0], np.zeros(int((w > 0).sum()), np.int64), 1, 4096) for w in (a, b))
    assert abs((sa == sb).mean() - exact) < 0.04


def test_texts_that_repeat_lines_meet_those_that_do_not(spark):
    """Recall by repetition: sets of similarity 0.8 to 0.9, where one text has a third of its lines many times."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(150):
        lines = [" ".join(word() for _ in range(20)) for _ in range(12)]
        other = [*lines[:11], " ".join(word() for _ in range(20))] if i % 2 else lines[:11]
        times = (1, 20, 50, 200)[i % 4]
        again = [line for line in lines[:4] for _ in range(times - 1)]
        rows += [(2 * i, "\n".join(lines + again), "en"), (2 * i + 1, "\n".join(other), "en")]
    want = brute_classes(rows)
    near = sum(want[2 * i] == want[2 * i + 1] for i in range(150))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(spark, rows)).collect()}
    assert near > 50 and got == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_near_dedup_keeps_columns(odd):
    left = near_dedup.without_near_duplicates(odd)
    assert left.columns == odd.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 10 in ids and 11 not in ids and 50 not in ids and ids.count(None) == 2


# 4 toxicity

def toxic_world(spark):
    rng = random.Random(3)
    bad = ["vile", "nasty", "awful", "gross"]
    rows, labels = [], []
    for i in range(600):
        n = rng.choice([0, 0, 0, 1, 3, 6])
        words = [f"w{rng.randrange(80)}" for _ in range(60)] + [rng.choice(bad) for _ in range(n)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        if i % 3:
            labels.append((i, 1, int(n > 0)))
    labels += [(5, 1, None), (99_999, 0, 1), (None, 1, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), set(bad)


def test_toxicity_on_held_out_rows(spark):
    rows, labels, bad = toxic_world(spark)
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    truth = {i: bool(set(t.split()) & bad) for i, t, _ in rows}
    density = {i: sum(w in bad for w in t.split()) for i, t, _ in rows}
    got = {r["doc_id"]: r for r in toxicity.graded(docs, model).collect()}
    unseen = [i for i in got if not i % 3]
    assert np.mean([got[i]["rejected"] == truth[i] for i in unseen]) > 0.97
    assert np.mean([got[i]["severity"] for i in unseen if density[i] == 6]) > np.mean([got[i]["severity"] for i in unseen if density[i] == 1])
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i in got if not got[i]["rejected"]}


def test_toxic_passages_in_long_texts(spark):
    """What stands around a passage takes nothing off its severity; held-out rows of every length."""
    rng = random.Random(13)
    bad = [f"bad{c}" for c in "abcdefghij"]
    clean = lambda n: ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    mix = lambda words, more: (at := rng.randrange(len(words) + 1)) and words[:at] + more + words[at:] or more + words
    rows, labels = [], []
    for i in range(1200):
        toxic = int(i % 8 == 0)
        rows.append((i, " ".join(mix(clean(rng.randint(40, 400)), rng.sample(bad, rng.randint(1, 5)) if toxic else [])), "en"))
        labels.append((i, toxic))
    unseen = [(2000 + i, " ".join(clean(n)), "en") for i, n in enumerate([50, 300, 2000] * 20)]
    added = {(k, n): [(10_000 * k + n + i, " ".join(mix(clean(n), rng.sample(bad, k))), "en") for i in range(15)]
             for k in (1, 2, 4, 6) for n in (50, 300, 2000)}
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    late = [r for some in added.values() for r in some]
    got = {r["doc_id"]: r["rejected"] for r in toxicity.graded(frame(spark, unseen + late), model).collect()}
    assert np.mean([got[i] for i, _, _ in unseen]) <= 0.02
    for (k, _), some in added.items():
        assert np.mean([got[i] for i, _, _ in some]) >= (0.9 if k > 1 else 0.6)
    assert model.severity([rows[0][1]])[0] <= model.severity([" ".join([*clean(640), rows[0][1], *clean(640)])])[0]


def test_worst_passage():
    place, weights = {"a": 0, "b": 1, "c": 2}, np.array([2.0, -0.5, 1.0])
    for n in (0, 1, 31, 63, 64, 65, 96, 97, 400):
        words = random.Random(n).choices(["a", "b", "c", "x"], [1, 3, 1, 30], k=n)
        starts = range(0, max(1, n - 32), 32)
        want = [sum(weights[place[w]] for w in set(words[s:s + 64]) if w in place) for s in starts]
        score, first, feature = toxicity.worst_passage(words, place, weights)
        assert (score, first) == (max(want), starts[want.index(max(want))])
        assert set(feature) == {place[w] for w in words[first:first + 64] if w in place}


def test_cumulative_gradient():
    """The fit is a maximum: no step of a single weight or cut raises the likelihood."""
    rng = np.random.default_rng(0)
    lists = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(400)]
    score = np.array([x.sum() * 0.5 for x in lists]) + rng.logistic(size=400)
    grades = np.digitize(score, [1.0, 3.0])
    weights, cuts = toxicity.fit_cumulative(lists, grades, 6, steps=3000)

    def loss(w, c):
        s = np.array([w[x].sum() for x in lists])
        p = 1 / (1 + np.exp(-(np.array([-50, *c, 50])[None, :] - s[:, None])))
        return -np.log(p[np.arange(400), grades + 1] - p[np.arange(400), grades]).mean() + toxicity.DECAY / 2 * (w ** 2).sum()

    best = loss(weights, cuts)
    for k in range(6):
        for d in (-0.05, 0.05):
            assert loss(weights + d * np.eye(6)[k], cuts) > best - 1e-5


def test_toxicity_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert all(r["severity"] < 1e-6 and not r["rejected"] for r in toxicity.graded(odd, model).collect())
    assert toxicity.graded(nothing, model).count() == 0


# 5 exact duplicates

def test_exact_groups(spark, odd_rows):
    groups = defaultdict(list)
    for doc_id, text, _ in odd_rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        want += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    docs = frame(spark, odd_rows)
    assert by_row(exact_dedup.duplicate_groups(docs)) == sorted(want, key=repr)
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)


def test_filters(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    packed = bitfilter.key_filter(keys, 5000)
    inside = np.array([r["key"] for r in keys.collect()])
    outside = np.array([r["key"] for r in spark.range(5000, 15000).selectExpr("xxhash64(id) as key").collect()])
    assert bitfilter.passes(packed, inside).all() and bitfilter.passes(packed, outside).mean() < 0.05
    twice = keys.unionByName(keys.limit(50))
    again = np.array([r["key"] for r in twice.groupBy("key").count().where("count > 1").collect()])
    packed = bitfilter.repeat_filter(twice, 5050)
    assert bitfilter.passes(packed, again).all() and bitfilter.passes(packed, inside).mean() < 0.1


# 6 benchmark leaks

def test_leaks(spark):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(40)]
    rare = lambda: "".join(rng.choice("bdfgklmnpr") + rng.choice("aeiou") for _ in range(4))
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rare() for _ in range(n)]
    items = [(k, text(rng.randint(14, 60))) for k in range(30)] + [(99, text(200))]
    rows, truth = [], set()
    for i in range(150):
        body = text(rng.choice([30, 120, 500]))
        if i % 3 == 0:
            k, words = items[i % len(items)]
            words = [rare() if i % 2 and j % 9 == 4 else w for j, w in enumerate(words)]  # some are reworded
            at = rng.randrange(len(body))
            body = body[:at] + words + body[at:]
            truth.add((i, k))
        rows.append((i, " ".join(body), "en"))
    rows += [(500, None, "en"), (501, "", "en"), (None, " ".join(items[0][1]), "en"), (rows[0][0], rows[0][1], "en")]
    bench = spark.createDataFrame([(k, " ".join(w).capitalize() + ".") for k, w in items] + [(None, "x"), (70, None), (71, "")],
                                  "item_id long, text string")
    got = decontamination.contaminated(frame(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == truth
    left = decontamination.without_contaminated(frame(spark, rows), bench)
    # the row without doc_id holds an item as well
    assert {r["doc_id"] for r in left.collect()} == {i for i, _, _ in rows} - {d for d, _ in truth} - {None}


def test_leaks_of_many_short_items(spark):
    """Verbatim copies among hundreds of items are found whatever their length; each pair has the LCS."""
    rng = random.Random(16)
    common = [f"c{k}" for k in range(300)]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    items = [(k, text((6, 12, 20, 40, 64)[k % 5])) for k in range(700)]
    rows, truth = [], set()
    for i in range(120):
        body, two = text(rng.choice([0, 60, 300])), rng.sample(items, 2)
        for k, words in two:
            at = rng.randrange(len(body) + 1) if not truth or i % 2 else len(body)
            body = body + words if at == len(body) or i % 2 == 0 else body[:at] + words + body[at:]
        held = f" {' '.join(body)} "
        truth |= {(i, k) for k, words in two if f" {' '.join(words)} " in held}
        rows.append((i, " ".join(body), "en"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert len(truth) > 200 and not truth - got.keys()
    assert all(r["lcs"] >= decontamination.LCS and -1 <= r["cosine"] <= 1 for r in got.values())


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_latent_space_is_fitted_on_all_passages(spark, monkeypatch, held):
    """The products of features and the vectors over thousands of documents, against dense matrices."""
    monkeypatch.setattr(decontamination, "HELD", held)
    rng = random.Random(26)
    vocabulary = [f"w{k:02d}" for k in range(40)]
    rows = [(i, " ".join(rng.choice([*vocabulary, "other", "more"]) for _ in range(rng.choice([0, 3, 10, 96, 97, 250]))), "en")
            for i in range(2500)] + [(None, "w00 w01 w00", "en"), (7, None, "en")]
    place = {w: i for i, w in enumerate(vocabulary[5:])}
    idf = np.array([1 + 0.1 * i for i in range(35)])
    passages = []
    for _, text, _ in rows:
        words = (text or "").split()
        for b in range(0, len(words), decontamination.WINDOW):
            v = np.zeros(35)
            for w in words[b:b + decontamination.WINDOW]:
                if w in place:
                    v[place[w]] += idf[place[w]]
            if v.any():
                passages.append(v / np.linalg.norm(v))
    a = np.array(passages)
    numbers = decontamination.numbered(frame(spark, rows), vocabulary)
    products = decontamination.passage_products(numbers, decontamination.feature_numbers(vocabulary, place), idf)
    got = np.zeros((35, 35))
    for r in products.collect():
        assert r["other"][0] == r["feature"] and len(set(r["other"])) == len(r["other"])
        got[r["feature"], r["other"]] = r["value"]
    assert np.allclose(got, np.triu(a.T @ a)) and np.isclose(np.trace(got), len(passages)) and len(passages) > 2000
    own = [(np.array([0, 3]), np.array([0.6, 0.8]))]
    basis = decontamination.randomised_svd(products, own, 3.0, 35, rank=35)
    row = np.zeros(35)
    row[[0, 3]] = 0.6, 0.8
    _, exact, _ = np.linalg.svd(np.vstack([a, 3 * row]), full_matrices=False)
    assert np.allclose(sorted(np.linalg.norm(np.vstack([a, 3 * row]) @ basis, axis=0)), sorted(exact), rtol=0.02)
    counts = decontamination.document_counts(numbers, vocabulary)
    assert counts == {w: sum(w in (t or "").split() for _, t, _ in rows) for w in vocabulary}


def test_leak_sums_come_from_few_tasks(spark, monkeypatch):
    """Many partitions: each task sends sums of its own, so the passages' products and each pass come from few."""
    monkeypatch.setattr(decontamination, "MULTIPLIERS", 2)
    rows = [(i, f"w{i % 5} w{(i + 1) % 5} w{(i * i) % 5}", "en") for i in range(400)]
    vocabulary = [f"w{k}" for k in range(5)]
    numbers = decontamination.numbered(frame(spark, rows).repartition(40), vocabulary)
    assert numbers.rdd.getNumPartitions() > 2
    tasks = []
    mapped = type(numbers).mapInArrow
    monkeypatch.setattr(type(numbers), "mapInArrow", lambda self, *a, **k: (tasks.append(self.rdd.getNumPartitions()), mapped(self, *a, **k))[1])
    idf = np.ones(5)
    products = decontamination.passage_products(numbers, decontamination.feature_numbers(vocabulary, {w: i for i, w in enumerate(vocabulary)}), idf)
    decontamination.randomised_svd(products, [(np.array([0]), np.array([1.0]))], 1.0, 5, rank=5)
    assert tasks[0] == 1 and max(tasks) <= 2


def test_leaks_of_nothing(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd, none).count() == 0
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontamination.contaminated(nothing, bench).count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {w: sum(1 << i for i, x in enumerate(a) if x == w) for w in a}
        assert decontamination.lcs_length(masks, len(a), b) == table[-1][-1]


# 7 packing

def plain_packing(lengths, window):
    """Best-fit decreasing, piece by piece: the number of windows."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            best = min(fits, key=lambda k: left[k])
            left[best] -= n
        else:
            left.append(window - n)
    return sorted(left)


def test_packing_rules_are_best_fit_decreasing():
    rng = random.Random(2)
    for window in (8, 50, 64):
        for _ in range(20):
            lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 300))]
            used = Counter()
            for length, first, last, sequence, each, offset in packing.packing_rules(Counter(lengths), window):
                for number in range(first, last):
                    used[sequence + (number - first) // each] += length
            assert sorted(window - n for n in used.values()) == plain_packing(lengths, window)


def test_packed(spark, odd_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    rows = [*odd_rows, (90, "<|endoftext|> and <|endoftext|>x", "en"), (91, " " * 5000 + "x\r\n é漢😀", "en")]
    got = packing.packed(frame(spark, rows)).collect()
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            some = ids[at:at + 1024]
            want[doc_id, at, len(some), zlib.crc32(some.tobytes()), len(ids)] += 1
    assert pieces == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_tokenizes_few_texts_at_once(spark, monkeypatch):
    """Parts of a batch: the pieces are those of the whole batch, whatever the bound."""
    rows = [(i, "some words " * (i % 7), "en") for i in range(60)] + [(None, None, "en")]
    docs = frame(spark, rows)
    want = sorted(map(repr, packing.cut_pieces(docs).collect()))
    monkeypatch.setattr(packing, "BATCH_BYTES", 50)
    assert sorted(map(repr, packing.cut_pieces(docs).collect())) == want and len(want) == 61


def test_packed_sequences_hold_the_ids(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    pieces = packing.packed(frame(spark, rows)).cache()
    got = pieces.collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
    windows = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert windows.keys() == {r["sequence_id"] for r in got}
    assert sum(len(w["ids"]) for w in windows.values()) == sum(r["length"] for r in got)
    for r in got:
        assert windows[r["sequence_id"]]["ids"][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    pieces.unpersist()


# 8 token counts

def test_token_counts(spark, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())
    rng = random.Random(9)
    rows = [*odd_rows, (90, " ▁a  ▁▁ b", "en"), (91, "<s> x</s> <unk> <0x0A>\x00😀ﬁ\r\n", "en"), (92, "tionsh" * 3000, "en")]
    rows += [(100 + k, "".join(rng.choice("abcdeé  ▁\n1漢tionsh") for _ in range(rng.randint(1, 80))), "en") for k in range(200)]
    got = token_counts.token_counts(frame(spark, rows))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert by_row(got) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [2, 2048])
def test_long_sequences_as_the_library(monkeypatch, most):
    """Sequences without a space merge round by round as well, whatever their length."""
    import sentencepiece

    monkeypatch.setattr(token_counts, "LONG", most)
    rng = random.Random(12)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    n = 20_000 if most > 2 else 300
    found = [draw(a, k) for a in ("a", "ab", "etaoinshr", "0123456789", "\u4e00\u4e8c\u4e09\u7684", "-=", " ", " a", "ab\u00e9\U0001f600\n", "aeiou ")
             for k in (1, 7, n // 3, n)]
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())
    merger = token_counts.Merger(token_counts.model_file())
    for text in found:
        assert merger.text_counts([text]) == [len(library.encode(text))]


# 10 language

def test_forward_backward():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 1, 70, 33, 128, 2])
    scores, transitions = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3))
    got, at = language_id.forward_backward(scores, sizes, transitions), 0
    step = np.exp(transitions)
    for n in sizes:
        emit = np.exp(scores[at:at + n])
        f, b, x = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3) / 3
        for t in range(n):
            x = (x @ step) * emit[t]
            x /= x.sum()
            f[t] = x
        for t in range(n - 2, -1, -1):
            b[t] = step @ (emit[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        assert np.allclose(f * b / (f * b).sum(1, keepdims=True), got[at:at + n])
        at += n


def test_language_of_held_out_rows(spark):
    docs = documents(spark, SF)
    model = language_id.fit(docs)
    truth = {i: lang for i, _, lang in texts_of(spark)}
    got = language_id.predicted(docs, model).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    texts = {lang: t for _, t, lang in texts_of(spark)}
    mixed = " ".join(texts["en"].split()[:15] + texts["fr"].split()[:15])
    labels = [k for _, k in language_id.word_labels(model, mixed)]
    assert labels[:10].count("en") >= 8 and labels[-10:].count("fr") >= 8


def test_language_of_odd_rows(spark, odd, odd_rows, nothing):
    model = language_id.fit(odd)
    got = language_id.predicted(odd, model)
    bare = {1, 2, 3, 6}
    for r in got.collect():
        assert (r["lang_pred"] == "und") == (r["doc_id"] in bare) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert got.count() == len(odd_rows)
    empty = language_id.fit(nothing)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in language_id.predicted(odd, empty).collect())


def test_empty_table(spark, nothing):
    for df in (license_scan.license_blocks(nothing), substring_dedup.without_repeats(nothing), near_dedup.near_classes(nothing),
               near_dedup.without_near_duplicates(nothing), exact_dedup.duplicate_groups(nothing),
               exact_dedup.without_duplicates(nothing), packing.packed(nothing), token_counts.token_counts(nothing),
               suffix_dedup.without_repeats(nothing)):
        assert df.count() == 0


def test_scratch_is_shared(spark):
    assert work_path(spark, "x") != work_path(spark, "x")


# rows that share a doc_id, and words whose polynomial hashes would agree

def doubled(n, a="ab"):
    """The word that is its own complement, doubled n times."""
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    return a


def two_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b = (" ".join(word() for _ in range(60)) for _ in range(2))
    return a, b, " ".join(word() for _ in range(60))


def test_words_with_one_polynomial_hash_differ(spark):
    word = doubled(10)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {word}", "en"), (2, f"{head} {word.translate({97: 98, 98: 97})}", "en")]
    assert [r["n_removed"] for r in substring_dedup.without_repeats(frame(spark, rows)).collect()] == [0, 0]


def test_rows_of_one_id_keep_their_own_text(spark):
    a, b, c = two_texts()
    near = a.split()
    near[30] = "other"
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en")]
    for op, size in ((substring_dedup, 60), (suffix_dedup, len(a))):
        got = {(r["doc_id"], r["kept_sha256"]): r["n_removed"] for r in op.without_repeats(frame(spark, rows)).collect()}
        empty = hashlib.sha256(b"").hexdigest()
        assert got == {(1, hashlib.sha256(a.encode()).hexdigest()): 0, (2, empty): size, (2, hashlib.sha256(b.encode()).hexdigest()): 0}
    kept = near_dedup.without_near_duplicates(frame(spark, [(1, a, "en"), (2, " ".join(near), "en"), (2, b, "en"), (3, c, "en")]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (2, b), (3, c)])


def test_leaks_by_row(spark):
    a, b, c = two_texts()
    items = spark.createDataFrame([(1, " ".join(a.split()[:30]))], "item_id long, text string")
    rows = [(1, a, "en"), (1, b, "en"), (None, a, "en"), (None, c, "en")]
    kept = decontamination.without_contaminated(frame(spark, rows), items)
    assert sorted(r["text"] for r in kept.collect()) == sorted([b, c])
    assert [r["doc_id"] for r in decontamination.contaminated(frame(spark, rows), items).collect()] == [1]


@pytest.mark.parametrize("frequent, together", [(2, 8192), (2, 3), (1, 1)])
def test_suffix_dedup_of_frequent_keys(spark, monkeypatch, frequent, together):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(6)
    middle = "".join(rng.choice("abcdefgh") for _ in range(40))
    around = ["".join(rng.choice("stuvwxyz") for _ in range(80)) for _ in range(6)]
    rows = [(i, rng.choice(around)[-rng.randint(20, 80):] + middle + rng.choice(around)[:rng.randint(20, 80)], "en") for i in range(60)]
    rows += [(100 + i, "ab" * rng.randint(40, 90) + t, "en") for i, (_, t, _) in enumerate(stringy(rng, "ab é\n", 12))]
    want = brute_repeats(rows, lambda t: t.encode(), bytes, 100)
    assert by_row(suffix_dedup.without_repeats(frame(spark, rows))) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rest_pairs_lose_no_link(spark, seed):
    """Variants of a text at all distances, with shingles of their own first in the order: every pair at 0.8 is proposed."""
    rng = np.random.default_rng(seed)
    sets = []
    for vertex in range(60):
        base = rng.permutation(100)[: rng.integers(80, 101)]
        sets.append((vertex, sorted({*map(int, base), *(1000 + 100 * vertex + k for k in range(rng.integers(0, 25)))})))
    table = spark.createDataFrame(sets, "vertex long, shingles array<long>")
    members = table.select(F.lit(1).alias("band"), "vertex", F.col("vertex").alias("label"))
    got = {(min(r), max(r)) for r in near_dedup.rest_pairs(
        members.unionByName(members.withColumn("band", F.lit(2))), table, table.select("vertex", F.size("shingles").alias("n"))).collect()}
    wanted = {(a, b) for a, x in sets for b, y in sets if a < b
              and len(set(x) & set(y)) * 10 >= 8 * len(set(x) | set(y))}
    assert wanted and wanted <= got


@pytest.mark.parametrize("bands", [1, 3])
def test_a_pair_leaves_the_rest_join_once(spark, bands):
    """Variants that share many differences and several centres: the join gives each pair one row."""
    rng = np.random.default_rng(5)
    # two forms, so most differences from a centre of the other form are shared by many
    sets = [(vertex, sorted({*range(200), *(range(300, 330) if vertex % 2 else ())} - {*map(int, rng.integers(0, 200, 18))}
                            | {1000 + 100 * vertex + k for k in range(12)})) for vertex in range(60)]
    table = spark.createDataFrame(sets, "vertex long, shingles array<long>")
    members = table.select(F.explode(F.array(*map(F.lit, range(bands)))).alias("band"), "vertex", F.col("vertex").alias("label"))
    # band k lacks vertices below k, so the bands have several centres
    members = members.where("band = 0 or pmod(xxhash64(vertex), 3) <> pmod(band, 3)")
    sizes = table.select("vertex", F.size("shingles").alias("n"))
    meeting, close = near_dedup.met_pairs(members, sizes, near_dedup.differences(members, table))
    rows = [tuple(sorted(r)) for r in meeting.collect()]
    assert len(rows) == len(set(rows)) > 100
    found = {*rows, *(tuple(sorted(r)) for r in close.collect())}
    assert found == {tuple(sorted(r)) for r in near_dedup.rest_pairs(members, table, sizes).collect()}
    assert {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) * 10 >= 8 * len(set(x) | set(y))} <= found


def test_rest_pairs_of_variants_under_the_threshold(spark):
    """Texts that each change some places of one text: the pairs proposed are few more than the similar ones."""
    rng = np.random.default_rng(4)
    sets = []
    for vertex in range(200):
        gone = {int(i) for at in rng.integers(0, 196, rng.integers(2, 6)) for i in range(at, at + 5)}
        sets.append((vertex, sorted({*range(200)} - gone | {1000 + 100 * vertex + k for k in range(len(gone))})))
    table = spark.createDataFrame(sets, "vertex long, shingles array<long>")
    members = table.select(F.lit(1).alias("band"), "vertex", F.col("vertex").alias("label"))
    got = {(min(r), max(r)) for r in near_dedup.rest_pairs(
        members, table, table.select("vertex", F.size("shingles").alias("n"))).collect()}
    wanted = {(a, b) for a, x in sets for b, y in sets if a < b
              and len(set(x) & set(y)) * 10 >= 8 * len(set(x) | set(y))}
    assert wanted <= got and len(wanted) > 1000 and len(got) < 1.25 * len(wanted)


def test_rows_of_the_rest_join_do_not_grow_with_the_differences(spark, monkeypatch):
    """Long lists of differences: a row of the join stands for one of them and carries no list of the others."""
    rng = np.random.default_rng(6)
    sets = [(vertex, sorted({*range(600)} - {*map(int, rng.integers(0, 600, 90))} | {1000 + 100 * vertex + k for k in range(40)}))
            for vertex in range(40)]
    table = spark.createDataFrame(sets, "vertex long, shingles array<long>")
    members = table.select(F.lit(1).alias("band"), "vertex", F.col("vertex").alias("label"))
    tables, store = {}, near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: tables.setdefault(label, store(df, label)))
    near_dedup.rest_pairs(members, table, table.select("vertex", F.size("shingles").alias("n"))).collect()
    rest = tables["near-rest"]
    held = sum(F.size(f.name) for f in rest.schema.fields if f.dataType.typeName() == "array")
    assert rest.count() > 1000 and rest.agg(F.max(held)).first()[0] == 0  # one centre, so none before it


def test_pairs_of_long_texts_are_told_apart_without_their_sets(spark):
    """Texts of thousands of shingles on both sides of the threshold: no similar pair is lost, and few others need their sets compared."""
    rng = np.random.default_rng(7)
    sets = [np.array(sorted({*range(3000)} - {*map(int, rng.choice(3000, gone, replace=False))}
                            | {10_000 + 1000 * vertex + k for k in range(gone)}), np.uint64)
            for vertex, gone in enumerate([120, 140, 450, 600] * 15)]
    odd = near_dedup.set_parities(np.concatenate(sets), np.repeat(np.arange(60), [len(x) for x in sets]), 60)
    table = spark.createDataFrame([(v, len(x), odd[v].tolist(), x.tolist()) for v, x in enumerate(sets)],
                                  "vertex long, n long, parity array<long>, shingles array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "a long, b long")
    wanted = {(a, b) for a in range(60) for b in range(a)
              if len(both := np.intersect1d(sets[a], sets[b])) * 10 >= 8 * (len(sets[a]) + len(sets[b]) - len(both))}
    got = {tuple(r) for r in near_dedup.maybe_similar(pairs, table).collect()}
    assert wanted <= got and 200 < len(wanted) < 800 and len(got) < 1.25 * len(wanted)
    assert {tuple(r) for r in near_dedup.verified(pairs, table).collect()} == wanted
