"""Continuous scoring and continuous grid ingest. Both are stateless."""

from nitrogrid.operators.grid import flatten_grid
from nitrogrid.plans.scoring import score_requests
from nitrogrid.schemas import GRID_BLOCK, SCORE_REQUEST


def read_request_stream(spark, folder, schema=SCORE_REQUEST, files_per_trigger=None, glob=None):
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(folder)


def read_block_stream(spark, folder, schema=GRID_BLOCK, files_per_trigger=None, glob=None):
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def score_stream(requests, predictor, as_of=None, range_check=True):
    """Scored request stream; the same plan as the batch one."""
    return score_requests(requests, predictor, as_of, range_check)


def flatten_stream(blocks, mode="strict", bbox=None, keep=("source_file",)):
    """Observation stream from a block stream."""
    return flatten_grid(blocks, mode, bbox, keep)


def start(stream, path, checkpoint, fmt="parquet", continuous=None):
    """Write a stream to files exactly once per input file.

    Without ``continuous`` (a processing interval) everything available is processed and
    the query ends.
    """
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()
