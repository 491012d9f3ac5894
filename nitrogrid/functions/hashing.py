"""Stable pseudo-random assignment of rows from their keys.

The value depends only on the seed and the key, so it survives repartitioning and
recomputation after an executor is lost.
"""

from pyspark.sql import functions as F

HASH_BITS = 52  # 13 hex digits: exact as bigint and as double


def key_hash(key, seed):
    """Integer in [0, 2^52)."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def unit_hash(key, seed):
    """Double in [0, 1)."""
    return key_hash(key, seed) / F.lit(float(2 ** HASH_BITS))


def fold(key, folds, seed):
    """Integer in [0, folds), independent of ``unit_hash`` for the same seed."""
    return (key_hash(key, f"fold:{seed}") % F.lit(folds)).cast("int")
