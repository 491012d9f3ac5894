"""Scoring requests: JSON files, JSON text columns, and batches of locations."""

from pyspark.sql import functions as F

from nitrogrid.schemas import BATCH_REQUEST, COVARIATES, SCORE_REQUEST


def read_requests(spark, path):
    return spark.read.schema(SCORE_REQUEST).json(path)


def read_batch_requests(spark, path):
    return spark.read.schema(BATCH_REQUEST).json(path)


def parse_requests(df, body="body", schema=SCORE_REQUEST, keep=()):
    """Requests from JSON text, for a table or a stream of messages."""
    parsed = df.select(*keep, F.from_json(body, schema).alias("_request"))
    return parsed.select(*keep, "_request.*")


def explode_batches(batches, keep=(), position=None):
    """One row per location; the shared covariates are kept. No shuffle.

    A request without locations keeps one row, whose location is null; ``has_locations`` is false
    where the request had no list at all. ``position`` names a column for the place in the list.
    """
    shared = [f.name for f in COVARIATES if f.name in batches.columns]
    located = (F.posexplode_outer("locations").alias(position, "_location") if position
               else F.explode_outer("locations").alias("_location"))
    rows = batches.select(*keep, *shared, F.col("locations").isNotNull().alias("has_locations"), located)
    return rows.select(*keep, *([position] if position else []), "_location.*", *shared, "has_locations")
