"""Streams written by micro-batch: ingest with two outputs, and replies to batch requests.

A micro-batch writes its tables below ``batch_id=...`` folders and, last of all, its commit. A batch
that ends half-way is written over when it is repeated; a committed batch that is repeated changes
nothing. Readers look at committed batches only.
"""

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.operators.grid import extract_variables, flatten_grid, rejected_blocks, valid_blocks, validate_blocks
from nitrogrid.operators.ordinals import with_ordinal
from nitrogrid.plans.scoring import score_batches
from nitrogrid.schemas import OBSERVATION
from nitrogrid.sinks.replies import batch_replies

BATCH = T.StructField("batch_id", T.LongType())
COMMITS = T.StructType([T.StructField("done", T.BooleanType())])
FILES = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("file_index", T.LongType())])
REJECTS = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("error", T.StringType())])
PREDICTION = T.StructType([
    T.StructField("no2_value", T.DoubleType()), T.StructField("air_quality", T.StringType()),
    T.StructField("air_quality_text", T.StringType()), T.StructField("color", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("name", T.StringType()),
])


def reply_schema(*keys):
    """Schema of written replies; ``keys`` are pairs of name and type."""
    return T.StructType([
        *[T.StructField(name, kind) for name, kind in keys], T.StructField("success", T.BooleanType()),
        T.StructField("predictions", T.ArrayType(PREDICTION)), T.StructField("count", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ])


def _exists(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _read(spark, out, name, schema):
    whole = T.StructType([*schema.fields, BATCH])
    path = f"{out}/{name}"
    return spark.read.schema(whole).parquet(path) if _exists(spark, path) else spark.createDataFrame([], whole)


def committed(spark, out, name, schema):
    """The rows of a table's committed batches, with their ``batch_id``."""
    commits = _read(spark, out, "commits", COMMITS).select("batch_id").distinct()
    return _read(spark, out, name, schema).join(commits, "batch_id", "left_semi")


def is_committed(spark, out, batch_id):
    path = f"{out}/commits/batch_id={batch_id}"
    return _exists(spark, path) and not spark.read.schema(COMMITS).parquet(path).isEmpty()


def _write(df, out, name, batch_id):
    df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")


def _commit(spark, out, batch_id):
    _write(spark.range(1).select(F.lit(True).alias("done")), out, "commits", batch_id)


def ingest_batch(batch, batch_id, out, mode="lenient", bbox=None):
    """Write one micro-batch of grid blocks: ``rows``, ``rejects`` and newly seen ``files``.

    Every block is either flattened or in ``rejects`` with its reason. Files are numbered from 0 on
    in the order of batches, by name within a batch, rejected ones too; a file that comes again
    keeps its number. A block without a file name has no number.
    """
    spark = batch.sparkSession
    if is_committed(spark, out, batch_id):
        return
    checked = validate_blocks(extract_variables(batch), mode).persist()
    try:
        # batches that were committed before; a repeated batch meets the same ones
        earlier = committed(spark, out, "files", FILES).filter(F.col("batch_id") < batch_id).select(*FILES.names)
        start = earlier.agg(F.coalesce(F.max("file_index") + 1, F.lit(0))).first()[0]
        names = checked.filter("source_file IS NOT NULL").select("source_file").distinct()
        _write(with_ordinal(names.join(earlier, "source_file", "left_anti"), "source_file", "file_index", start),
               out, "files", batch_id)
        fresh = spark.read.schema(FILES).parquet(f"{out}/files/batch_id={batch_id}")
        # this batch's files only, looked up once per block, before blocks become rows
        here = earlier.join(names, "source_file", "left_semi").unionByName(fresh)
        numbered = valid_blocks(checked).join(here, "source_file", "left")
        rows = flatten_grid(numbered, mode, bbox, keep=("source_file", "file_index"))
        _write(rows.select(*OBSERVATION.names), out, "rows", batch_id)
        _write(rejected_blocks(checked).select(*REJECTS.names), out, "rejects", batch_id)
    finally:
        checked.unpersist()
    _commit(spark, out, batch_id)


def reply_batch(batch, batch_id, out, predictor, keep=("request_id",), as_of=None, range_check=True):
    """Write the replies of one micro-batch of batch requests, one per request row.

    All locations of a request are in its row and so in one micro-batch: grouping within the batch
    is complete and needs no state. Requests that share an id get a reply each.
    """
    spark = batch.sparkSession
    if is_committed(spark, out, batch_id):
        return
    known = batch.withColumn("_request", F.struct(F.monotonically_increasing_id().alias("_row"), *keep))
    scored = score_batches(known, predictor, as_of, ["_request"], range_check, position="position")
    replies = batch_replies(scored, "_request").select(
        *[F.col(f"_request.{c}").alias(c) for c in keep], "success", "predictions", "count", "error")
    _write(replies, out, "replies", batch_id)
    _commit(spark, out, batch_id)


def _start(stream, handle, checkpoint, continuous):
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def start_ingest(blocks, out, checkpoint, mode="lenient", bbox=None, continuous=None):
    """Ingest a stream of blocks; without ``continuous`` (an interval) what is available, then end."""
    return _start(blocks, partial(ingest_batch, out=out, mode=mode, bbox=bbox), checkpoint, continuous)


def start_replies(requests, out, checkpoint, predictor, keep=("request_id",), as_of=None, range_check=True,
                  continuous=None):
    """Answer a stream of batch requests; without ``continuous`` what is available, then end."""
    handle = partial(reply_batch, out=out, predictor=predictor, keep=keep, as_of=as_of, range_check=range_check)
    return _start(requests, handle, checkpoint, continuous)
