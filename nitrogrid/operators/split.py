"""Train / validation / test assignment by key."""

import math

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.hashing import key_hash, unit_hash
from nitrogrid.operators.quantiles import value_at_share


def split_rows(df, key, test_size=0.2, val_size=None, seed=K.SEED):
    """Add ``split``: ``test``, ``val`` (when asked for) or ``train``.

    The share of each part is met in expectation; see ``split_rows_exact`` for exact counts.
    """
    u = unit_hash(F.col(key), seed)
    label = F.when(u < test_size, F.lit("test"))
    if val_size:
        label = label.when(u < test_size + val_size, F.lit("val"))
    return df.withColumn("split", label.otherwise(F.lit("train")))


def split_rows_exact(df, key, test_size=0.2, seed=K.SEED, accuracy=10_000):
    """Two-way split with exactly ``ceil(n * test_size)`` test rows. ``key`` must be unique.

    The threshold is an exact order statistic of the key hash, found by a few narrow jobs.
    Rows that share the threshold hash are told apart by key.
    """
    hashed = df.select(key_hash(F.col(key), seed).alias("_hash"), F.col(key).alias("_key"))
    found = value_at_share(
        hashed, "_hash", test_size, lambda n: math.ceil(n * test_size) - 1, accuracy
    )
    if found is None:
        return df.withColumn("split", F.lit("test"))
    threshold, below, equal, k = found
    wanted = k + 1 - below
    h = key_hash(F.col(key), seed)
    in_test = h <= threshold
    if wanted < equal:
        # a hash collision at the threshold: take the smallest keys
        tied = hashed.filter(F.col("_hash") == threshold).orderBy("_key").limit(wanted)
        last = tied.agg(F.max("_key")).first()[0]
        in_test = (h < threshold) | ((h == threshold) & (F.col(key) <= F.lit(last)))
    return df.withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))


def split_sizes(df):
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
