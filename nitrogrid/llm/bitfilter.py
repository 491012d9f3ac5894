"""Bloom filters over 64-bit keys, built by Spark and sent to all tasks.

A filter has a power of two of bits, at most MOST_BITS (128 MB), so what is broadcast has a fixed
bound. Beyond it the filter only lets more rows through; every user of a filter decides exactly
among the rows that pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 30
CHUNK = 1 << 16


def bits_for(keys: int) -> int:
    """The number of bits for so many keys."""
    wanted = 1 << max(0, keys * BITS_PER_KEY - 1).bit_length()
    return min(MOST_BITS, max(LEAST_BITS, wanted))


def cells(key, bits: int):
    """The two cells of a key, as an array column. The keys are hashes already."""
    return F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))


def gathered(set_cells: DataFrame, bits: int) -> np.ndarray:
    """The bit array with the given cells (column cell) set. A group has CHUNK cells at most."""
    chunked = set_cells.select((F.col("cell") / CHUNK).cast("int").alias("chunk"), (F.col("cell") % CHUNK).cast("int").alias("bit"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(CHUNK, np.uint8)
        flags[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "packed": [np.packbits(flags, bitorder="little").tobytes()]})

    packed = np.zeros(bits // 8, np.uint8)
    rows = chunked.groupBy("chunk").applyInPandas(pack, "chunk int, packed binary")
    for row in rows.toLocalIterator():
        at = row["chunk"] * (CHUNK // 8)
        packed[at:at + CHUNK // 8] = np.frombuffer(row["packed"], np.uint8)
    return packed


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A filter of the given distinct keys (column key)."""
    bits = bits_for(count)
    return gathered(keys.select(F.explode(cells(F.col("key"), bits)).alias("cell")).distinct(), bits)


def repeat_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A filter of the keys (column key) that may occur twice: cells that were met twice."""
    bits = bits_for(count)
    met = keys.select(F.explode(cells(F.col("key"), bits)).alias("cell"))
    return gathered(met.groupBy("cell").count().where("count > 1").select("cell"), bits)


def passes(packed: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each key (int64 or uint64), whether both its cells are set."""
    key = key.view(np.uint64) if key.dtype == np.int64 else key
    mask = np.uint64(len(packed) * 8 - 1)
    found = np.ones(len(key), bool)
    for cell in (key & mask, (key >> np.uint64(32)) & mask):
        found &= (packed[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def tester(spark, packed: np.ndarray):
    """A column function: whether a key passes the filter."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, key.to_numpy(np.int64)))

    return test


def rows_near(rows: DataFrame, name: str, ids: DataFrame, id_name: str) -> DataFrame:
    """The rows whose column `name` is among the ids, and a few more: what is left to be joined.

    ids: distinct, from a stored table. Rows that are surely not among them need not shuffle.
    """
    packed = key_filter(ids.select(F.xxhash64(id_name).alias("key")), ids.count())
    return rows.where(F.col(name).isNotNull() & tester(rows.sparkSession, packed)(F.xxhash64(name)))
