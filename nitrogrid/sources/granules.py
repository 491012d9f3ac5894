"""Granule discovery and grid-block scans."""

import re
from functools import reduce
from operator import and_

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid import constants as K
from nitrogrid.functions.text import plain_path
from nitrogrid.operators.grid import extract_variables, validate_blocks
from nitrogrid.operators.lineage import with_source_file
from nitrogrid.schemas import GRID_BLOCK
from nitrogrid.session import work_path
from nitrogrid.sources.files import list_files, listed

# files without rows up to this size are looked at in tasks, by so many paths in a read
SMALL = 16 << 20
PATHS_TOGETHER = 1000
URI = "_uri"


def granules_by_glob(listing, pattern=K.GRANULE_GLOB):
    """Files of a listing that match a case-sensitive glob of ``*`` and ``?``."""
    like = pattern.replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return listing.filter(F.col("file_name").like(like))


def granules_by_token(listing, tokens=None, suffix=K.GRANULE_SUFFIX):
    """Files whose name holds all tokens, in any order and case; the suffix is case-sensitive."""
    tokens = K.GRANULE_NAME_TOKENS if tokens is None else tokens
    name = F.col("file_name")
    wanted = reduce(and_, [F.upper(name).contains(t.upper()) for t in tokens], name.endswith(suffix))
    return listing.filter(wanted)


def find_granules(spark, folder, pattern=K.GRANULE_GLOB):
    """Granules of a folder by glob, applied while the folder is listed."""
    return list_files(spark, folder, pattern)


def find_granules_by_token(spark, folder, tokens=None, suffix=K.GRANULE_SUFFIX):
    return granules_by_token(list_files(spark, folder), tokens, suffix)


def _reader(spark, schema, glob):
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)


def _tolerant(spark, schema, glob, folder):
    """A scan that passes damage by; only for finding out what is missing."""
    return _reader(spark, schema, glob).option("ignoreCorruptFiles", True).parquet(folder)


def read_blocks(spark, paths, mode="strict", schema=GRID_BLOCK, glob=None):
    """Grid blocks with an ``error`` column: a bad block is reported, not fatal.

    A damaged file ends the scan. ``checked_blocks`` reports such files and reads the others.
    """
    blocks = _reader(spark, schema, glob).parquet(*_as_list(paths))
    return validate_blocks(extract_variables(blocks), mode)


def read_foreign_blocks(spark, paths, mode="strict", glob=None):
    """Blocks whose variables carry other accepted names; schema merged from the files."""
    blocks = _reader(spark, None, glob).parquet(*_as_list(paths))
    if "source_file" not in blocks.columns:
        blocks = with_source_file(blocks)
    return validate_blocks(extract_variables(blocks), mode)


def _no_rows(spark, files):
    """Of files without rows (``uri, path, length``), those that are sound: nothing but a footer of the stated length.

    Contents are read in tasks; of the few that are large, only the last bytes.
    """
    small = [r.path for r in files.filter(F.col("length") <= SMALL).select("path").collect()]
    large = files.filter(F.col("length") > SMALL).select("uri", "path", "length").collect()
    footer = F.conv(F.hex(F.reverse(F.substring("content", -8, 4))), 16, 10).cast("long")
    marked = F.substring("content", -4, 4) == F.lit(b"PAR1")
    sound = spark.createDataFrame([(r.uri,) for r in large if _bare(spark, r.path, r.length)], "uri string")
    for at in range(0, len(small), PATHS_TOGETHER):
        # special characters of a glob stand for themselves in these paths
        paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in small[at:at + PATHS_TOGETHER]]
        read = spark.read.format("binaryFile").load(paths).withColumn("uri", F.col("_metadata.file_path"))
        sound = sound.unionByName(read.filter(marked & (footer + 12 == F.col("length"))).select("uri"))
    return sound


def _bare(spark, path, length):
    """Whether the last bytes of a file say that it is nothing but a footer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(length - 8)
        tail = bytes(stream.readNBytes(8))
    finally:
        stream.close()
    return tail[4:] == b"PAR1" and int.from_bytes(tail[:4], "little") + 12 == length


def _faults(spark, folder, glob, schema, read):
    """Files that do not give all rows their footers state; ``read`` (``uri, read``) counts what a scan gave."""
    stated = _tolerant(spark, schema, glob, folder).groupBy(F.col("_metadata.file_path").alias("uri")) \
        .agg(F.count(F.lit(1)).alias("stated"))
    # the listing, the footers and what was read are one row per file; written, as they are used twice
    path = work_path(spark, "granule-files")
    listed(spark, folder, glob).join(stated, "uri", "left").join(read, "uri", "left").write.parquet(path)
    files = spark.read.parquet(path)
    none = files.filter("stated IS NULL")
    files = files.join(_no_rows(spark, none).withColumn("bare", F.lit(True)), "uri", "left")
    error = (
        F.when(F.col("stated").isNull() & F.coalesce("bare", F.lit(False)), None)
        .when(F.col("stated").isNull(), F.lit("unreadable file"))
        .when(F.coalesce("read", F.lit(0)) != F.col("stated"),
              F.format_string("damaged file: %d of %d rows", F.coalesce("read", F.lit(0)), F.col("stated")))
    )
    return files.select("uri", "path", "file_name", error.alias("error")).filter("error IS NOT NULL")


def file_faults(spark, folder, glob="*.parquet", schema=GRID_BLOCK):
    """Files of a folder that do not give all their rows: ``path, file_name, error``.

    The number of rows that the footers state (a scan of no column) is compared, per file, with
    the number that a scan of every column gives. A file without rows is sound if it is nothing
    but a footer of the stated length. ``checked_blocks`` finds the same while it reads the data.
    """
    rows = _tolerant(spark, schema, glob, folder)
    every = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(f.dataType, T.MapType) else F.col(c)
                         for c, f in ((f"`{f.name}`", f) for f in rows.schema)])
    read = rows.select(F.col("_metadata.file_path").alias("uri"), every.alias("h")).groupBy("uri") \
        .agg(F.count(F.lit(1)).alias("read"), F.bit_xor("h").alias("_all"))
    # always true, but keeps the scan of every column
    read = read.filter(F.col("_all").isNotNull()).select("uri", "read")
    return _faults(spark, folder, glob, schema, read).drop("uri")


def checked_blocks(spark, folder, mode="lenient", glob="*.parquet", wanted=None, schema=None):
    """``(blocks, faults)`` of a folder: all blocks of sound files, and the files left out whole.

    The folder's data is read once: its blocks are written to the shared folder with the address of
    their file, and the rows that arrived there per file are compared with what its footers state.
    A file that breaks on the way has rows missing and is left out whole, with the reason. Blocks,
    rejects and file numbers are then read from what was written. Files are known by the address
    that scans state for them, whatever characters their names have.

    Without a schema it is merged from the files, which may name their variables differently.
    ``wanted`` (column ``path``, as in the listing) restricts both to some files; it may be as long
    as the listing.
    """
    if schema is None:
        # taken from the files that have one; a folder without any has no blocks
        schema = _tolerant(spark, None, glob, folder).schema
    blocks = _tolerant(spark, schema, glob, folder).withColumn(URI, F.col("_metadata.file_path"))
    if "source_file" not in blocks.columns:
        blocks = with_source_file(blocks)
    files = None
    if wanted is not None:
        paths = wanted.select(plain_path(F.col("path")).alias("path")).distinct()
        files = listed(spark, folder, glob).join(paths, "path", "left_semi").select(F.col("uri").alias(URI))
        blocks = blocks.join(files, URI, "left_semi")
    path = work_path(spark, "granules")
    blocks.write.parquet(path)
    landed = spark.read.schema(blocks.schema).parquet(path)
    read = landed.groupBy(F.col(URI).alias("uri")).agg(F.count(F.lit(1)).alias("read"))
    faults = _faults(spark, folder, glob, schema, read)
    if files is not None:
        faults = faults.join(files.withColumnRenamed(URI, "uri"), "uri", "left_semi")
    out = work_path(spark, "granule-faults")
    faults.write.parquet(out)
    faults = spark.read.schema(faults.schema).parquet(out)
    sound = landed.join(faults.select(F.col("uri").alias(URI)), URI, "left_anti").drop(URI)
    return validate_blocks(extract_variables(sound), mode), faults.drop("uri")


def decode_granules(spark, folder, decoder, pattern=K.GRANULE_GLOB, schema=GRID_BLOCK):
    """Grid blocks decoded from binary files by a user's function.

    ``decoder(name, content)`` returns the block's fields as a dict, for example with a
    NetCDF library. Each file is decoded in the task that reads it; a file that cannot be
    decoded gives a block with ``decode_error``, the reason that validation then rejects it for.
    """
    decoded = T.StructType([*schema.fields, T.StructField("decode_error", T.StringType())])

    def decode(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                row = dict.fromkeys(decoded.names)
                try:
                    row.update(decoder(name, content))
                except Exception as e:
                    row["decode_error"] = f"{type(e).__name__}: {e}"
                row["source_file"] = name
                rows.append(row)
            yield pd.DataFrame(rows, columns=decoded.names)

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select("path", "content")
    )
    return files.mapInPandas(decode, decoded)


def _as_list(paths):
    return [paths] if isinstance(paths, str) else list(paths)


def unread_files(spark, folder, glob="*.parquet", schema=GRID_BLOCK):
    """Files of a folder that cannot be read, in whole or in part, with the reason."""
    return file_faults(spark, folder, glob, schema)
