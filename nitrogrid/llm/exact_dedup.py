"""Exact duplicates by two passes of a Bloom filter.

Pass one counts the filter cells of all text hashes; cells that were met twice form a filter of the
hashes that may be repeated. Pass two tests each row against it: rows that fail are unique and pass
straight through, only the others shuffle, as hashes, to be grouped exactly.

Defined cases: a null text is an empty text. A null doc_id comes after all others. Of rows with one
text and one doc_id, one stays. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrogrid.llm import bitfilter
from nitrogrid.llm.common import SPACE_CLASS, id_and_text, parquet_rows, ship, stored


def text_hash(text: Column) -> Column:
    """SHA-256 of a text whose runs of white space are single spaces."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " "), 256))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    hashes = stored(
        id_and_text(docs).select("doc_id", text_hash(F.col("text")).alias("sha"))
        .withColumn("key", F.xxhash64("sha")),
        "exact-hashes",
    )
    packed = bitfilter.repeat_filter(hashes.select("key"), parquet_rows(hashes))
    tested = hashes.withColumn("repeated", bitfilter.tester(spark, packed)("key"))
    single = tested.where(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    # stored, so that the join below reads them by its own exchange and can split a hot text
    rows = stored(tested.where("repeated").groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "exact-rows")
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    several = (
        rows.join(groups, "sha")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha",
        )
    )
    return single.unionByName(several).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Rows that the filter passes by are untouched. Of the others each task first keeps the best row
    of each text it holds, so a large group of copies shuffles one row per task.
    """
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    row = F.struct(*[docs[n] for n in names])
    hashed = docs.select(row.alias("row"), text_hash(docs["text"]).alias("sha"), docs["doc_id"].alias("id")) \
        .withColumn("key", F.xxhash64("sha"))
    keys = stored(hashed.select("key"), "exact-keys")
    packed = bitfilter.repeat_filter(keys, parquet_rows(keys))
    tested = hashed.withColumn("repeated", bitfilter.tester(spark, packed)("key"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64("row"))
    best = tested.where("repeated").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    kept = tested.where(~F.col("repeated")).select("row").unionByName(best.select("row"))
    return kept.select("row.*")
