"""Where rows come from: source file, position in the file list, unions."""

from functools import reduce

from pyspark.sql import functions as F

from nitrogrid.operators.ordinals import with_ordinal


def file_indexes(files, source="source_file"):
    """``source_file, file_index``: position (from 0) in the sorted list of distinct files.

    The list has one row per file, and is numbered without gathering it in one task.
    """
    return with_ordinal(files.select(source).distinct(), source, "file_index")


def with_file_index(df, files=None, source="source_file"):
    """Add ``file_index``. Pass the whole file list to keep gaps for rejected files.

    Use it on grid blocks rather than on flattened rows: one lookup per block instead of one
    per value.
    """
    indexes = file_indexes(df if files is None else files, source)
    return df.join(indexes, source, "left")


def with_source_file(df):
    """Add the base name of the file each row was read from."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def union_all(frames, schema=None, spark=None):
    """UNION ALL by name; columns that one side lacks are null. No frames: a typed empty one."""
    frames = list(frames)
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
