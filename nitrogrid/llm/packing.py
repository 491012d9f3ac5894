"""Packing of token ids into windows of fixed length by best-fit decreasing.

Tasks tokenize whole texts and cut each document into full windows and a remainder; the pieces carry
their ids. The packing itself depends on how many pieces there are of each length:
best-fit decreasing treats equal lengths alike. So the driver packs a histogram of at most
`window` entries, with a segment tree over the remaining capacities, and gets rules of the form
"pieces number i to j of length s go to windows from k, so many in each". Spark numbers the pieces
of each length and joins the rules. No list of pieces is ever in one place.

Defined cases: a null text is empty and gives the one end id. Repeated rows are packed each. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nitrogrid.llm.common import id_and_text, pieces_of, stored, texts, tidy

WINDOW = 1024
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
NUMBERED_TOGETHER = 50_000
BATCH_BYTES = 1 << 20

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"

_loaded: dict[str, object] = {}


def token_ids(text: str, folder_path) -> np.ndarray:
    """The ids of a text under byte_bpe_50k, special strings inside it included.

    tiktoken reads the same vocabulary several times faster; a text that its pattern engine refuses
    (a million spaces in a row) goes to the tokenizers library.
    """
    if "fast" not in _loaded:
        import tiktoken

        import public_tokenizers

        with open(folder_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded["fast"] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    try:
        return _loaded["fast"].encode_to_numpy(text, allowed_special="all")
    except ValueError:
        if "plain" not in _loaded:
            from tokenizers import Tokenizer

            _loaded["plain"] = Tokenizer.from_file(folder_path("byte_bpe_50k.json"))
        return np.array(_loaded["plain"].encode(text, add_special_tokens=False).ids, np.uint32)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, folder_path=tokenizer_file) -> DataFrame:
    """One row per piece: full windows of each document and what is left over."""

    def cut(batches):
        for batch in (part for whole in batches for part in pieces_of(whole, BATCH_BYTES)):
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.append(token_ids(text, folder_path), np.uint32(end_id)).astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    found.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32)))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return id_and_text(docs).mapInArrow(tidy(cut), PIECE)


class Capacities:
    """A segment tree over remaining capacities: the tightest one that has open windows."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.filled = [False] * (2 * self.size)

    def mark(self, capacity: int, filled: bool) -> None:
        at = capacity + self.size
        self.filled[at] = filled
        while at > 1:
            at //= 2
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open window."""
        at = least + self.size
        if self.filled[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.filled[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def packing_rules(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    A rule (length, first, last, sequence, each, offset): the pieces of that length numbered from
    first to before last go, `each` to a window, to the windows from `sequence`, beginning at
    `offset`. A length makes one rule for each run of equal open windows that it fills, so the
    number of rules is bounded by the window length squared, whatever the number of pieces.
    """
    tree = Capacities(window)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rules, opened = [], 0

    def add(capacity: int, first: int, last: int) -> None:
        if capacity > 0 and last > first:
            runs[capacity].append((first, last))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                each = window // length
                first, last = opened, opened + -(-(total - done) // each)
                opened = last
            else:
                each = capacity // length
                first, last = runs[capacity].pop()
                if not runs[capacity]:
                    tree.mark(capacity, False)
            placed = min(total - done, each * (last - first))
            full, rest = divmod(placed, each)
            rules.append((length, done, done + placed, first, each, window - capacity))
            done += placed
            add(capacity - each * length, first, first + full)
            if rest:
                add(capacity - rest * length, first + full, first + full + 1)
            add(capacity, first + full + (rest > 0), last)
    return rules


def packed(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, folder_path=tokenizer_file) -> DataFrame:
    """One row per piece with its token ids, its sequence_id and its offset there."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, window, end_id, folder_path), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rules = packing_rules(counts, window)
    shares = max(1, max(counts.values(), default=0) // NUMBERED_TOGETHER)

    # number the pieces of a length: within a share of them, plus what the shares before hold
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)))
    before = (
        dealt.groupBy("length", "share").count()
        .withColumn("base", F.sum("count").over(
            Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "share", F.coalesce("base", F.lit(0)).alias("base"))
    )
    numbered = (
        dealt.withColumn("place", F.row_number().over(
            Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(before, ["length", "share"])
        .withColumn("number", F.col("place") + F.col("base"))
    )
    rule_rows = spark.createDataFrame(
        rules, "of long, first long, last long, sequence long, each long, at long")
    within = F.col("number") - F.col("first")
    return (
        numbered.join(F.broadcast(rule_rows), (F.col("length") == F.col("of"))
                      & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids",
            (F.col("sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
            (F.col("at") + within % F.col("each") * F.col("length")).alias("offset"),
        )
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window of packed(): sequence_id, its token ids in order, and the lengths of its pieces."""
    # a window holds a bounded number of ids
    held = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.length").alias("lengths"))
