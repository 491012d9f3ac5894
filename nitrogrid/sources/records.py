"""CSV files with line breaks in cells, read in as many tasks as their size asks for.

Spark cuts a file into splits of whole physical lines. A line begins a record if an even number of
quotes stands before it in the file. Each task counts along its split for both cases, as it does
not know which one holds at the split's begin; a running sum over one row per split then says so,
and how many records begin before it. Lines that are a record each, nearly all, stay where they
are; only the lines of records that go over several lines meet by file and record number, also
from both sides of a split's border.
"""

import csv

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "value string, _file string, _split long, _id long, _odd int, _before int, _even long, _uneven long"


def _counted(batches):
    """Lines with the parity of quotes before them in their split, and the records begun in it so far, for an
    even and for an odd number of quotes before the split."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at, carry = None, None
    for batch in batches:
        value = batch.column("value")
        odd = np.asarray(pc.count_substring(value, '"'), np.int64) % 2
        blank = np.asarray(pc.equal(pc.binary_length(pc.utf8_rtrim(value, "\r")), 0), bool)
        names, places = batch.column("_file").to_pylist(), batch.column("_split").to_pylist()
        before, even, uneven = (np.zeros(len(odd), np.int64) for _ in range(3))
        start = 0
        while start < len(odd):
            end = start
            while end < len(odd) and places[end] == places[start] and names[end] == names[start]:
                end += 1
            if (names[start], places[start]) != at:
                at, carry = (names[start], places[start]), (0, 0, 0)
            some = slice(start, end)
            upto = carry[0] + np.cumsum(odd[some])
            before[some] = (upto - odd[some]) % 2
            even[some] = carry[1] + np.cumsum((before[some] == 0) & ~blank[some])
            uneven[some] = carry[2] + np.cumsum((before[some] == 1) & ~blank[some])
            carry = int(upto[-1]) % 2, int(even[end - 1]), int(uneven[end - 1])
            start = end
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("value", "_file", "_split", "_id")), pa.array(odd, pa.int32()), pa.array(before, pa.int32()),
             pa.array(even), pa.array(uneven)], names=["value", "_file", "_split", "_id", "_odd", "_before", "_even", "_uneven"])


def split_records(spark, path):
    """``file, record, text``: the records of CSV files, numbered from 1 in each file; blank lines are none.

    A line break in a cell is given as ``\\n``, with the carriage return before it if there is one.
    A quote that is never closed makes the rest of its file one record, as in any reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    ).mapInArrow(_counted, LINE)
    splits = lines.groupBy("_file", "_split").agg(
        (F.sum("_odd") % 2).alias("_odd"), F.max("_even").alias("_even"), F.max("_uneven").alias("_uneven"))
    # one row per split of the scan
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_odd").over(earlier) % 2, F.lit(0)).cast("int"))
    begun = F.when(F.col("_open") == 0, F.col("_even")).otherwise(F.col("_uneven"))
    splits = splits.withColumn("_offset", F.coalesce(F.sum(begun).over(earlier), F.lit(0))) \
        .select("_file", "_split", "_open", "_offset")
    inside = F.pmod(F.col("_before") + F.col("_open"), F.lit(2)) == 1
    record = F.col("_offset") + F.when(F.col("_open") == 0, F.col("_even")).otherwise(F.col("_uneven"))
    placed = lines.join(F.broadcast(splits), ["_file", "_split"]).select(
        F.col("_file").alias("file"), record.alias("record"), inside.alias("_inside"), "_odd", "_split", "_id", "value")
    whole = ~F.col("_inside") & (F.col("_odd") == 0)
    text = F.regexp_replace("value", "\r$", "")
    single = placed.filter(whole & (text != "")).select("file", "record", text.alias("text"))
    several = placed.filter(~whole).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("_split", "_id", "value"))).alias("_lines")
    ).select("file", "record", F.regexp_replace(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"), "\r$", "").alias("text"))
    return single.unionAll(several)


def read_split_texts(spark, path, columns=None, name="row_number"):
    """All cells as text, with the number of each record in its file; the header is record 1 of each file.

    The columns are those of the first file's header, unless given. Cells past the last column are
    left out, missing ones are null.
    """
    records = split_records(spark, path)
    if columns is None:
        heads = records.filter("record = 1").select(F.min(F.struct("file", "text")).alias("h")).first()["h"]
        if heads is None:
            return spark.createDataFrame([], T.StructType([T.StructField(name, T.LongType())]))
        columns = next(csv.reader([heads["text"].removeprefix("\ufeff")]))
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    parsed = F.from_csv("text", ddl, {"escape": '"'})
    return records.filter("record > 1").select(parsed.alias("r"), F.col("record").alias(name)).select("r.*", name)
