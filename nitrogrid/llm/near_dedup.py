"""Near duplicates by ProbMinHash, banding and exact verification.

A document is the weighted set of its shingles of five words; a shingle that stands n times weighs
1 + REPEATED * (1 - 1 / n), so less than 1 + REPEATED: the sets decide, and a text that repeats its lines must
still meet one that has each of them once. Each shingle is a Poisson process of that rate whose arrivals fall on random registers; a
register keeps its earliest arrival. An element stops once its next arrival is later than all
registers of the document, so most elements make one arrival. Two documents agree in a register
with the probability Jaccard similarity of their sets. Registers are banded; documents that share a
band are candidates, and the Jaccard similarity of their shingle sets decides (SIMILAR or more).

Documents with one shingle set are one vertex from the start, so copies never form pairs. The
candidates of a band are tested against one centre of it, the vertices that this leaves apart
against a few centres of other classes, and what is left then against one centre of each of its bands. What still
shares a band without sharing a class is joined by the rarest of the shingles in which the sets
differ from that centre (prefix filter): each pair that can reach the threshold is tested there, so no
link among the candidates is lost. What a group has in common is no difference, so variants of one
text that stay under the threshold do not all meet, and a common passage that many unlike
documents share proposes nothing.

Defined cases: texts without words stay apart. Fewer than five words make one shingle. A row
without doc_id meets only rows of its own shingle set. Repeated rows are one vertex; rows of one
doc_id with different texts are judged each by its text, and of a class one text stays. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nitrogrid.llm import bitfilter
from nitrogrid.llm.common import mixed, pieces_of, ship, stored, tidy, with_text_key
from nitrogrid.llm.components import components
from nitrogrid.llm.textarrays import words

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
REPEATED = 0.25  # what a shingle that is repeated without end weighs more than one that stands once
BATCH_BYTES = 1 << 20
CENTRES = (1, 4)  # centres per band in the rounds before the rest is joined
PARITIES = 512  # buckets of a set of differences; a multiple of 64
SET_PARITIES = 4096  # buckets of a whole set; a multiple of 64

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash, how often, document), sorted by document and hash."""
    w = words(column)
    count = np.diff(w.first)
    hashes = np.zeros(len(w.hashes), np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(width, np.uint64)])
    left = np.repeat(w.first[1:], count) - np.arange(len(w.hashes))  # words from here to the document's end
    factor = np.uint64(1)
    for k in range(width):
        hashes += np.where(left > k, padded[k:k + len(hashes)], np.uint64(0)) * factor
        factor = np.uint64(int(factor) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    number = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(hashes)) - np.repeat(w.first[:-1], count)
    take = (left >= width) | (place == 0)
    hashes, number = mixed(hashes[take]), number[take]
    order = np.lexsort((hashes, number))
    hashes, number = hashes[order], number[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), number[at]


def weights(times: np.ndarray) -> np.ndarray:
    """Weight of a shingle by how often it stands."""
    return 1 + REPEATED * (1 - 1 / times)


def signatures(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that came first in each register, per document. Early termination by document."""
    earliest = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    arrival, going, turn = np.zeros(len(shingle)), np.arange(len(shingle)), 0
    while len(going):
        turn += 1
        random = mixed(shingle[going] + np.uint64(turn * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        arrival = arrival + gap / weight[going]
        slot = doc[going] * registers + (mixed(random) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(arrival < earliest[slot])
        sooner = sooner[np.lexsort((shingle[going[sooner]], arrival[sooner]))][::-1]  # the earliest is written last
        earliest[slot[sooner]], winner[slot[sooner]] = arrival[sooner], shingle[going[sooner]]
        limit = earliest.reshape(docs, registers).max(axis=1)
        on = arrival < limit[doc[going]]
        going, arrival = going[on], arrival[on]
    return winner.reshape(docs, registers)


def band_keys(winner: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band of the registers."""
    docs, registers = winner.shape
    rows = winner.reshape(docs, bands, registers // bands)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (docs, bands)).copy()
    for k in range(rows.shape[2]):
        keys = mixed(keys * _GOLDEN + rows[:, :, k])
    return keys


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_a, set_b (both halves of the set's hash), n (shingles) and bands of each row with words."""

    def sketch(batches):
        for whole in batches:
            for batch in pieces_of(whole, BATCH_BYTES):
                shingle, times, doc = shingle_sets(batch.column("text"))
                docs_here = batch.num_rows
                keys = band_keys(signatures(shingle, weights(times), doc, docs_here))
                n = np.bincount(doc, minlength=docs_here)
                edge = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(shingle + np.uint64(k)))]) for k in (1, 2)]
                a, b = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
                on = np.flatnonzero(n)
                flat = keys[on].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(on)) for c in ("doc_id", "text_key")), pa.array(a[on]), pa.array(b[on]), pa.array(n[on]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * BANDS, pa.int32()), pa.array(flat))],
                    names=["doc_id", "text_key", "set_a", "set_b", "n", "bands"])

    return with_text_key(docs).mapInArrow(tidy(sketch), "doc_id long, text_key long, set_a long, set_b long, n long, bands array<long>")


def set_parities(shingle: np.ndarray, doc: np.ndarray, docs: int, buckets: int = SET_PARITIES) -> np.ndarray:
    """Per document a row of 64-bit words: for each bucket of its shingles, a bit that says whether their number is odd."""
    at, met = np.unique(doc * buckets + (mixed(shingle) % np.uint64(buckets)).astype(np.int64), return_counts=True)
    at = at[met % 2 == 1]
    bits = np.zeros(docs * buckets // 8, np.uint8)
    np.add.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))  # each bit comes once, so nothing is carried
    return bits.view(np.int64).reshape(docs, buckets // 64)


def vertex_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, n, parity, shingles) for the wanted vertices (vertex, doc_id, text_key: distinct, from a stored table).

    Texts that are surely not among them do not shuffle.
    """

    def sets(batches):
        for whole in batches:
            for batch in pieces_of(whole, BATCH_BYTES):
                shingle, _, doc = shingle_sets(batch.column("text"))
                n = np.bincount(doc, minlength=batch.num_rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                odd = set_parities(shingle, doc, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vertex"), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * odd.shape[1], pa.int32()), pa.array(odd.reshape(-1))),
                     pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(shingle.view(np.int64)))],
                    names=["vertex", "n", "parity", "shingles"])

    rows = bitfilter.rows_near(with_text_key(docs), "doc_id", wanted.select("doc_id").distinct(), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"])
    return stored(rows.mapInArrow(tidy(sets), "vertex long, n long, parity array<long>, shingles array<long>"), "near-sets")


def _odd():
    """In how many buckets the columns parity and parity_b differ."""
    buckets = F.zip_with("parity", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(buckets, F.lit(0), lambda total, x: total + x)


def maybe_similar(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) without those whose parities tell that they are not similar.

    Each bucket of other parity holds a shingle that one of the two has and the other has not, and similar sets differ
    in (1 - similar) / (1 + similar) * (n + m) shingles at most. So no similar pair is lost, and few others take whole sets along.
    """
    here = sets.select("vertex", "n", "parity")
    most = F.lit((1 - similar) / (1 + similar)) * (F.col("n") + F.col("n_b")) + 1e-6
    return (
        pairs.select("a", "b").join(here.withColumnRenamed("vertex", "a"), "a")
        .join(here.withColumnsRenamed({"vertex": "b", "n": "n_b", "parity": "parity_b"}), "b")
        .where(_odd() <= most).select("a", "b")
    )


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity."""

    def test(batches):
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (xs, ys))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum()) if len(x) else 0
                good[i] = both >= similar * (len(x) + len(y) - both)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return (
        maybe_similar(pairs, sets, similar)
        .join(sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("y")), "b")
        .mapInArrow(tidy(test), "a long, b long")
    )


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (vertex, label) after joining the labels that the edges (a, b: vertices) connect."""
    names = labels.select(F.col("vertex").alias("v"), "label")
    links = (
        edges.join(names.withColumnsRenamed({"v": "a", "label": "la"}), "a")
        .join(names.withColumnsRenamed({"v": "b", "label": "lb"}), "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    roots = components(links, "near-classes")
    return stored(
        labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
        .select("vertex", F.coalesce("root", "label").alias("label")), "near-labels")


def centre_pairs(members: DataFrame, centres: int) -> DataFrame:
    """Pairs (a: vertex, b: centre of another label), at most `centres` for each vertex.

    members: band, vertex, label. A band's members are dealt by a hash to so many shares, and each
    share has a centre; of the centres that its bands offer, a vertex takes those that most of them do.
    """
    dealt = members.withColumn("share", F.pmod(F.xxhash64("vertex", F.lit(centres)), F.lit(centres)))
    first = F.min(F.struct(F.xxhash64("vertex"), "vertex", "label")).alias("centre")
    chosen = stored(dealt.groupBy("band", "share").agg(first).select(
        "band", F.col("centre.vertex").alias("b"), F.col("centre.label").alias("other")), "near-centres")
    offered = (
        members.join(chosen, "band").where("label <> other")
        .groupBy("vertex", "b").agg(F.count("*").alias("shared"))
    )
    if centres == 1:
        return offered.groupBy("vertex").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")) \
            .select(F.col("vertex").alias("a"), "b")
    # a vertex has a row per centre of its bands at most
    place = F.row_number().over(Window.partitionBy("vertex").orderBy(F.desc("shared"), "b"))
    return offered.withColumn("place", place).where(F.col("place") <= centres).select(F.col("vertex").alias("a"), "b")


def mixed_bands(members: DataFrame) -> DataFrame:
    """The members of bands that hold more than one label."""
    several = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    return members.join(several, "band", "left_semi")


def grouped(members: DataFrame) -> DataFrame:
    """(vertex, label, centre), distinct: the vertices that share a band share its centre, a vertex of that band."""
    # another order than that of centre_pairs, so that most of these centres are new to their bands
    centres = members.groupBy("band").agg(F.min_by("vertex", F.struct(F.xxhash64("vertex", F.lit("rest")), "vertex")).alias("centre"))
    return members.join(centres, "band").select("vertex", "label", "centre").distinct()


def differences(members: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vertex, centre, linked, only, parity) for the centres of the vertex's bands: whether both are similar, the
    shingles that one of the two has and the other has not, and for PARITIES buckets whether their number is odd."""

    def differ(batches):
        for batch in batches:
            linked, only = np.zeros(batch.num_rows, bool), []
            odd = np.zeros((batch.num_rows, PARITIES), np.uint8)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                only.append(np.setxor1d(x, y, assume_unique=True))
                both = (len(x) + len(y) - len(only[-1])) // 2
                linked[i] = both >= similar * (len(x) + len(y) - both)
                bucket = mixed(only[-1].view(np.uint64)) % np.uint64(PARITIES)
                odd[i] = np.bincount(bucket.astype(np.int64), minlength=PARITIES) & 1
            edge = np.concatenate([[0], np.cumsum([len(o) for o in only])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vertex"), batch.column("centre"), pa.array(linked),
                 pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *only]))),
                 pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (PARITIES // 64), pa.int32()),
                                          pa.array(np.packbits(odd, axis=1).view(np.int64).reshape(-1)))],
                names=["vertex", "centre", "linked", "only", "parity"])

    pairs = (
        grouped(members).select("vertex", "centre")
        .join(sets.select("vertex", F.col("shingles").alias("x")), "vertex")
        .join(sets.select(F.col("vertex").alias("centre"), F.col("shingles").alias("y")), "centre")
    )
    return stored(pairs.select("vertex", "centre", "x", "y").mapInArrow(
        tidy(differ), "vertex long, centre long, linked boolean, only array<long>, parity array<long>"), "near-differences")


def rest_pairs(members: DataFrame, sets: DataFrame, sizes: DataFrame, similar: float = SIMILAR,
               different: DataFrame | None = None) -> DataFrame:
    """Pairs of different labels that share a band's centre and may be similar, all similar ones among them.

    Each set is told by where it differs from the centre c, so what a whole band has in common drops out
    and proposes nothing. x and y are similar if they differ in at most least = (1 - similar) / (1 + similar) * (n + m)
    shingles, n and m being their sizes. With a = |x ^ c| and b = |y ^ c| these two sets of differences then
    share t = (a + b - least) / 2 shingles or more, so for t > 0, in any common order, they meet within
    the first a - t + 1 and b - t + 1 of them; the order here is by frequency in the group of c, rarest
    first. m <= n / similar bounds least by (1 - similar) / similar * n, and b - a is at most least, so for
    a <= b that is among the first least / 2 + 1 of x and the first least + 1 of y. At the first one they share, what
    follows in both must suffice for the rest of t (positional filter), so no pair is lost by asking that of each meeting.
    Nor by asking that at most least buckets have other parities: each of them holds a shingle in which x and y differ.

    For t <= 0 both are similar to c itself, as a - (1 - similar) / (1 + similar) * n is least for c. Such pairs
    are looked for only around centres whose similar vertices have several labels; once the links to
    the centres have joined labels there are none.
    """
    if different is None:
        different = differences(members, sets, similar)
    meeting, close = met_pairs(members, sizes, different, similar)
    return meeting.unionByName(close).distinct()


def met_pairs(members: DataFrame, sizes: DataFrame, different: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The pairs of rest_pairs as (a, b): those that meet at a difference, each once, and those around a centre.

    A pair may share many centres and many shingles. Each centre alone finds it, so it is given only under the first
    centre that both have. What holds at any shingle that both share holds at those they shared before as well, where
    more follows, so they need not meet where both have the same shingle before: of a stretch of shared shingles
    the first one counts. The join's rows carry their centres and one shingle, not all that comes before, nor the parities:
    a row stands for one difference, and texts differ in hundreds. Each pair is brought to its parities once.
    """
    # a little more than the exact bounds: they must not fail by rounding
    share, slack = F.lit((1 - similar) / (1 + similar)), 1e-6
    before = Window.partitionBy("vertex").orderBy("centre").rowsBetween(Window.unboundedPreceding, -1)
    told = stored(
        different.select("vertex", "centre", F.size("only").alias("apart"), "linked")
        .join(grouped(members), ["vertex", "centre"]).join(sizes, "vertex")
        .withColumn("centres", F.collect_list("centre").over(before)), "near-told")
    # the exploded rows go through both exchanges with nothing but their keys; those met once only count, as they come first
    each = different.select("vertex", "centre", F.explode("only").alias("shingle"))
    one = Window.partitionBy("vertex", "centre")
    rarest = one.orderBy("met", "shingle")
    placed = (
        each.withColumn("met", F.count("*").over(Window.partitionBy("centre", "shingle"))).where("met > 1")
        .withColumn("place", F.row_number().over(rarest)).withColumn("previous", F.lag("shingle").over(rarest))
        .withColumn("common", F.count("*").over(one)).drop("met")
    )
    most = F.lit((1 - similar) / similar) * F.col("n") + slack
    prefix = stored(
        placed.join(told, ["vertex", "centre"]).withColumn("place", F.col("apart") - F.col("common") + F.col("place"))
        .where(F.col("place") <= most + 1)
        .select("centre", "shingle", "vertex", "label", "n", "apart", "place", "previous", "centres"), "near-rest")
    other = lambda df: df.withColumnsRenamed(
        {c: f"{c}_b" for c in ("vertex", "label", "n", "apart", "place", "previous", "centres", "parity")})
    follow = F.least(F.col("apart") - F.col("place"), F.col("apart_b") - F.col("place_b")) + 1
    least = share * (F.col("n") + F.col("n_b"))
    first = F.coalesce(F.col("previous") != F.col("previous_b"), F.lit(True))
    meeting = prefix.where(F.col("place") <= most / 2 + 1).join(other(prefix), ["centre", "shingle"]).where(
        (F.col("label") != F.col("label_b")) & (F.struct("apart", "vertex") < F.struct("apart_b", "vertex_b"))
        & (F.least("n", "n_b") >= similar * F.greatest("n", "n_b") - slack)
        & (2 * follow >= F.col("apart") + F.col("apart_b") - least - slack)
        & first & ~F.arrays_overlap("centres", "centres_b"))
    parities = different.select("vertex", "centre", "parity")
    meeting = (
        meeting.select("centre", "vertex", "vertex_b", least.alias("least")).distinct()
        .join(parities, ["vertex", "centre"]).join(other(parities), ["vertex_b", "centre"])
        .where(_odd() <= F.col("least") + slack)
    )
    around = told.where("linked").select("centre", "vertex", "label", "n", "apart")
    several = around.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("centre")
    around = stored(around.join(several, "centre", "left_semi"), "near-around")
    close = around.join(other(around), "centre").where(
        (F.col("label") != F.col("label_b")) & (F.struct("apart", "vertex") < F.struct("apart_b", "vertex_b"))
        & (F.col("apart") + F.col("apart_b") <= least + slack))
    pair = [F.col("vertex").alias("a"), F.col("vertex_b").alias("b")]
    return meeting.select(pair), close.select(pair)


def keyed_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """near_classes with text_key, which tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    rows = stored(sketched(docs), "near-sketches")
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    by_set = stored(rows.groupBy("set_a", "set_b").agg(
        F.min(place).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies"),
        F.min_by("bands", F.coalesce("doc_id", F.lit(0))).alias("bands")), "near-by-set")
    # a set is known by its first doc_id; sets that share one, as the id stands for several texts, by a hash of all
    twice = stored(by_set.where("first is not null").groupBy(F.col("first.doc_id").alias("of")).count().where("count > 1").select("of"),
                   "near-twice")
    vertices = stored(
        by_set.join(twice, by_set["first.doc_id"] == twice["of"], "left")
        .withColumn("vertex", F.when(F.col("of").isNull(), F.col("first.doc_id"))
                    .otherwise(F.xxhash64("first.doc_id", "first.text_key", "set_a", "set_b"))).drop("of"), "near-vertices")
    named = vertices.where("vertex is not null")
    labels = stored(named.select("vertex", F.col("vertex").alias("label")), "near-labels")
    bands = named.select("vertex", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("met")).where("met > 1").select("band")
    members = stored(bands.join(shared, "band", "left_semi"), "near-bands")
    wanted = stored(named.select("vertex", "first.*").join(members.select("vertex").distinct(), "vertex", "left_semi"), "near-wanted")
    sets = vertex_sets(docs, wanted)
    apart = members.withColumn("label", F.col("vertex"))
    for centres in CENTRES:
        edges = stored(verified(centre_pairs(apart, centres), sets, similar), "near-links")
        if edges.isEmpty():
            continue
        labels = relabelled(labels, edges)
        apart = stored(mixed_bands(members.join(labels, "vertex")), "near-apart")
    if not apart.isEmpty():
        different = differences(apart, sets, similar)
        edges = different.where("linked and vertex <> centre").select(F.col("vertex").alias("a"), F.col("centre").alias("b"))
        if not edges.isEmpty():
            labels = relabelled(labels, edges)
            apart = stored(mixed_bands(members.join(labels, "vertex")), "near-apart")
    if not apart.isEmpty():
        edges = stored(verified(rest_pairs(apart, sets, named.select("vertex", "n"), similar, different), sets, similar), "near-links")
        if not edges.isEmpty():
            labels = relabelled(labels, edges)
    classed = vertices.join(labels, "vertex", "left")
    sizes = classed.where("label is not null").groupBy("label").agg(F.sum("copies").alias("total"), F.min("first").alias("head"))
    by_set = classed.join(sizes, "label", "left").select(
        "set_a", "set_b", "head", F.coalesce("total", "copies").alias("class_size"))
    found = rows.select("doc_id", "text_key", "set_a", "set_b").join(by_set, ["set_a", "set_b"]).select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "class_size",
        (F.col("head").isNull() | F.coalesce(F.struct("doc_id", "text_key") == F.col("head"), F.lit(False))).alias("kept"), "text_key")
    # texts without words are not in rows; they are their own classes
    bare = with_text_key(docs).where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_key")
    return found.unionByName(bare)


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of the class), class_size, kept."""
    return keyed_classes(docs, similar).drop("text_key")


def without_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that are the first of their class, with the columns of docs."""
    classes = keyed_classes(docs, similar)
    dropped = stored(classes.where(~F.col("kept") & F.col("doc_id").isNotNull())
                     .select(F.col("doc_id").alias("dropped"), F.col("text_key").alias("dropped_key")).distinct(), "near-dropped")
    same = (docs["doc_id"].cast("long") == dropped["dropped"]) & (F.xxhash64(docs["text"].cast("string")) == dropped["dropped_key"])
    return docs.join(dropped, same, "left_anti")
