"""Consecutive numbers for a distributed table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from nitrogrid.session import work_path

# the task and the task's file in the name of a written file
FILE = r"^part-(\d+)-.*-c(\d+)"


def with_ordinal(df, key, name="ordinal", start=0):
    """Number the rows ``start``, ``start`` + 1 ... in the order of ``key``; null keys come first.

    The rows are written in that order to the shared folder. A task may write several files (as
    ``spark.sql.files.maxRecordsPerFile`` has it); their names number the task and its files. A
    row's number is its place in its file plus the rows of the files before, which is a running sum
    over one row per file: no task sees more than its part, whatever the keys are like. Rows with
    one key are numbered once, in the written table, so later reads agree.
    """
    spark = df.sparkSession
    path = work_path(spark, "ordered")
    df.orderBy(key).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*",
        F.regexp_extract("_metadata.file_name", FILE, 1).cast("int").alias("_part"),
        F.regexp_extract("_metadata.file_name", FILE, 2).cast("int").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    sizes = rows.groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_file", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # one row per file of a table that was written just now
    return rows.join(F.broadcast(offsets), ["_part", "_file"]).withColumn(
        name, F.col("_offset") + F.col("_row") + F.lit(start)
    ).select(*[f"`{c}`" for c in df.columns], name)
