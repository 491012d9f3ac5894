"""File listings as DataFrames; file contents are never read."""

from pyspark.sql import functions as F

from nitrogrid.functions.text import base_name, plain_path


def list_files(spark, folder, glob="*"):
    """Rows ``path, file_name, length, modified`` of the files in a folder."""
    return listed(spark, folder, glob).drop("uri")


def listed(spark, folder, glob="*"):
    """The listing with ``uri``: a file's address as every scan of the folder states it in its metadata."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("uri"))
    )
    return listing.select(
        plain_path(F.col("path")).alias("path"), base_name(F.col("path")).alias("file_name"), "length", "modified", "uri")
