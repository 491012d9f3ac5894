"""Reply envelopes for scored requests."""

from pyspark.sql import functions as F

from nitrogrid import constants as K

PREDICTION_FIELDS = [
    "no2_value", "air_quality", "air_quality_text", "color", "latitude", "longitude", "timestamp",
]


def single_replies(scored, keep=()):
    """``success, prediction, error`` per request."""
    ok = F.col("error").isNull()
    return scored.select(
        *keep,
        ok.alias("success"),
        F.when(ok, F.struct(*PREDICTION_FIELDS)).alias("prediction"),
        "error",
    )


def batch_replies(scored, request="request_id", order="position"):
    """``success, predictions, count, error`` per batch request.

    Places without coordinates or outside the box give no prediction. A request without a list of
    locations gets the error text. A reply holds as many predictions as its request held
    locations, and the request was one row, so the group has the size of an input row.
    """
    fields = F.struct(*PREDICTION_FIELDS, "name")
    listed = F.array_sort(F.collect_list(
        F.when(F.col("error").isNull(), F.struct(F.col(order).alias("o"), fields.alias("p")))
    ))
    grouped = scored.groupBy(request).agg(listed.alias("l"), F.bool_and("has_locations").alias("ok"))
    return grouped.select(
        request,
        F.col("ok").alias("success"),
        F.when(F.col("ok"), F.transform("l", lambda e: e["p"])).alias("predictions"),
        F.when(F.col("ok"), F.size("l")).alias("count"),
        F.when(~F.col("ok"), F.lit(K.MESSAGE_LOCATIONS_REQUIRED)).alias("error"),
    )


def write_replies(replies, path, mode="errorifexists"):
    replies.write.mode(mode).json(path)
    return path
