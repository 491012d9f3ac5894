"""License scan: an exact set-similarity join of text blocks with license templates.

A document's words fall into overlapping blocks, which begin every STRIDE words. A template is the set of
its distinct words, and a block meets it when it holds at least `threshold` of them. The blocks held
against a template are as long as it and STRIDE words more (BLOCK at least), so a whole notice lies in one of
them wherever it begins, however long it is. Template words are ordered by their frequency in the whole
collection (one Spark aggregate), rarest first:

- prefix filter: a block that meets a template has one of its first |T| - need + 1 words, so only
  blocks around such words are looked at;
- length filter: a block with fewer than `need` template words is passed by;
- positional filter: the words from the first common one on, on either side, must reach `need`.

The filters drop no pair that meets the threshold. Base phrases are templates with threshold 1
whose words must then stand consecutively; each place is counted in the block its start belongs to.
The templates are a parameter of fixed size; they are all that goes to every task.

`template_blocks` says which block meets which template; `license_blocks` gives one row per document.

Defined cases: a null text is empty. Repeated rows are scanned each. Without a base place,
first_word and last_word are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm.common import id_and_text, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BLOCK, STRIDE = 48, 24
THRESHOLD = Fraction(4, 5)

# fixed values: the phrases that a result must name, and their labels
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# wordings of further notices
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution": "cc",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "subject to the terms of the mozilla public license": "mpl",
}
# fixed values: the wording of public licenses
BODIES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
    "permit persons to whom the software is furnished to do so subject to the following conditions the above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with "
    "the distribution": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
    "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language "
    "governing permissions and limitations under the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
    "more details": "gpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held "
    "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
    "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
    "following restrictions": "zlib",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
    "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
    "commercial or non commercial and by any means": "unlicense",
}

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")
MET = "doc_id long, label string, template string, first_word long, n_words long, shared long, containment double"


@dataclass
class Template:
    label: str
    words: list[str]
    tokens: list[str]
    need: int
    phrase: bool

    @property
    def blocks(self) -> int:
        """How many strides long a block for this template is."""
        return max(BLOCK // STRIDE, 1 + ceil(len(self.words) / STRIDE))

    def reordered(self, rank: dict[str, int]) -> Template:
        return Template(self.label, self.words, sorted(self.tokens, key=rank.__getitem__), self.need, self.phrase)


def templates(base=None, further=None, threshold=THRESHOLD) -> list[Template]:
    base, further = BASE if base is None else base, {**TEMPLATES, **BODIES} if further is None else further
    found = []
    for phrases, phrase in ((base, True), (further, False)):
        for text, label in phrases.items():
            words = WORD.findall(text.translate(LOWER))
            if not words:
                raise ValueError(f"a template needs words: {text!r}")
            tokens = sorted(set(words))
            found.append(Template(label, words, tokens, len(tokens) if phrase else ceil(threshold * len(tokens)), phrase))
    return found


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.islower() else text)


def token_frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """How often each template word stands in the whole collection."""

    def count(batches):
        for batch in batches:
            met = Counter()
            for text in texts(batch):
                met.update(w for w in words_of(text) if w in vocabulary)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["token", "n"])

    rows = id_and_text(docs).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


class Scanner:
    def __init__(self, ordered: list[Template], rank: dict[str, int]):
        self.templates, self.rank = ordered, rank
        self.reach = [t.blocks for t in ordered]
        self.prefix: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(ordered):
            for p, token in enumerate(t.tokens[:len(t.tokens) - t.need + 1]):
                self.prefix.setdefault(token, []).append((k, p))

    def candidates(self, hits):
        """(block, template) pairs that a prefix word proposes."""
        found = set()
        for i, w in hits:
            if w in self.prefix:
                b = i // STRIDE
                for k, _ in self.prefix[w]:
                    found.update((c, k) for c in range(max(0, b - self.reach[k] + 1), b + 1))
        return sorted(found)

    def scan(self, words: list[str]):
        """Base places, base labels, and (first word, template, common words) of each block that meets a further template."""
        rank = self.rank
        hits = [(i, w) for i, w in enumerate(words) if w in rank]
        at = [i for i, _ in hits]
        places, base, met = [], set(), []
        for b, k in self.candidates(hits):
            t = self.templates[k]
            start = b * STRIDE
            block = {w for _, w in hits[bisect_left(at, start):bisect_left(at, start + t.blocks * STRIDE)]}
            if len(block) < t.need:  # length filter
                continue
            common = next((p for p, w in enumerate(t.tokens) if w in block), None)
            if common is None:
                continue
            after = sum(rank[w] >= rank[t.tokens[common]] for w in block)
            if min(len(t.tokens) - common, after) < t.need:  # positional filter
                continue
            shared = sum(w in block for w in t.tokens)
            if shared < t.need:
                continue
            if not t.phrase:
                met.append((start, t, shared))
                continue
            n = len(t.words)
            for i in at[bisect_left(at, start):bisect_left(at, start + STRIDE)]:
                if words[i:i + n] == t.words:
                    places.append(i)
                    base.add(t.label)
        return places, base, met


def ranked(docs: DataFrame, base, further, threshold) -> tuple[list[Template], dict[str, int]]:
    """The templates with their words in the order of the collection, and that order."""
    plain = templates(base, further, threshold)
    vocabulary = frozenset(w for t in plain for w in t.tokens)
    counts = token_frequencies(docs, vocabulary)
    rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    return [t.reordered(rank) for t in plain], rank


def license_blocks(docs: DataFrame, base=None, further=None, threshold=THRESHOLD) -> DataFrame:
    """One row per row of docs: base phrase places, all labels met, and the best containment."""
    ordered, rank = ranked(docs, base, further, threshold)

    def scan(batches):
        scanner = Scanner(ordered, rank)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                places, named, met = scanner.scan(words)
                labels = named | {t.label for _, t, _ in met}
                score = 1.0 if named else max((n / len(t.tokens) for _, t, n in met), default=0.0)
                rows.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                             ",".join(sorted(named)), ",".join(sorted(labels)), score))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return id_and_text(docs).mapInArrow(scan, RESULT)


def template_blocks(docs: DataFrame, base=None, further=None, threshold=THRESHOLD) -> DataFrame:
    """One row per block that meets a further template.

    doc_id, label, template (its text), first_word and n_words of the block, how many distinct words of
    the template it shares, and their part of all. Overlapping blocks that meet it are a row each.
    """
    ordered, rank = ranked(docs, base, further, threshold)

    def scan(batches):
        scanner = Scanner(ordered, rank)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                rows += [(doc_id, t.label, " ".join(t.words), start, min(t.blocks * STRIDE, len(words) - start), n, n / len(t.tokens))
                         for start, t, n in scanner.scan(words)[2]]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "label", "template", "first_word", "n_words", "shared", "containment"])

    return id_and_text(docs).mapInArrow(scan, MET)


def oracle_sql() -> str:
    """The same result by brute force over all blocks and templates."""
    known = templates()
    lists = [(t, "[" + ", ".join(f"'{w}'" for w in t.words) + "]", "[" + ", ".join(f"'{w}'" for w in t.tokens) + "]")
             for t in known]
    base = ",\n".join(f"('{t.label}', {words})" for t, words, _ in lists if t.phrase)
    further = ",\n".join(f"('{t.label}', {tokens}, {t.need}, {t.blocks * STRIDE})" for t, _, tokens in lists if not t.phrase)
    return rf"""
        WITH base(label, phrase) AS (VALUES {base}),
        further(label, tokens, need, width) AS (VALUES {further}),
        w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ),
        places AS (
            SELECT doc_id, label, i - 1 AS place
            FROM (SELECT doc_id, words, label, phrase, unnest(range(1, len(words) + 1)) AS i FROM w, base
                  WHERE list_has_all(words, phrase))
            WHERE words[i:i + len(phrase) - 1] = phrase
        ),
        blocks AS (
            SELECT doc_id, width, list_distinct(words[s + 1:s + width]) AS tokens
            FROM (SELECT doc_id, words, unnest(range(0, len(words), {STRIDE})) AS s FROM w), (SELECT DISTINCT width FROM further)
        ),
        met AS (
            SELECT doc_id, label, len(list_intersect(b.tokens, f.tokens)) / len(f.tokens) AS share
            FROM blocks b JOIN further f USING (width)
            WHERE len(list_intersect(b.tokens, f.tokens)) >= need
        ),
        named AS (
            SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM places GROUP BY doc_id
        ),
        every AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM (SELECT doc_id, label, 1.0::double AS share FROM places UNION ALL SELECT * FROM met)
            GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
        FROM w LEFT JOIN named USING (doc_id) LEFT JOIN every USING (doc_id)
    """
