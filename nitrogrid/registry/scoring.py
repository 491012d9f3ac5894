"""Registered queries: request scoring with a formula predictor, batch and streaming."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.functions.text import fixed3, scientific
from nitrogrid.plans import scoring as S
from nitrogrid.registry import views as V
from nitrogrid.schemas import BATCH_REQUEST, SCORE_REQUEST
from nitrogrid.session import work_path
from nitrogrid.sinks.replies import batch_replies, single_replies
from nitrogrid.sources.requests import parse_requests
from nitrogrid.streaming import pipelines as P


def _shown(scored, *keep):
    return scored.select(
        *keep, V.scaled("no2_value"), "air_quality", "color", F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"), "error",
    )


def score_validate(spark, sf):
    return S.with_range_error(V.requests(spark, sf)).select("event_id", "error")


def score_defaults(spark, sf):
    rows = S.with_defaults(V.requests(spark, sf), V.AS_OF)
    return rows.select(
        "event_id", "month", "day_of_year", "is_weekend",
        *[F.round(c, 6).alias(c) for c in ("temperature", "wind_speed", "humidity")],
    )


def score_requests(spark, sf):
    scored = S.score_requests(V.requests(spark, sf), S.formula_predictor(), V.AS_OF)
    return _shown(scored, "event_id")


def score_json(spark, sf):
    """Requests as JSON text in, replies as JSON text out."""
    bodies = V.requests(spark, sf).select("event_id", F.to_json(F.struct("*")).alias("body"))
    parsed = parse_requests(bodies, keep=["event_id"])
    scored = S.score_requests(parsed, S.formula_predictor("boxes"), V.AS_OF)
    replies = single_replies(scored, keep=["event_id"]).select(
        "event_id", F.to_json(F.struct("success", "prediction", "error")).alias("reply")
    )
    reply = F.from_json("reply", "success BOOLEAN, prediction STRUCT<no2_value: DOUBLE, air_quality: STRING>, error STRING")
    return replies.select("event_id", reply.alias("r")).select(
        "event_id",
        "r.success",
        F.round(F.col("r.prediction.no2_value") / 1e13, 6).alias("no2_value"),
        "r.prediction.air_quality",
        "r.error",
    )


def batch_score(spark, sf):
    scored = S.score_batches(
        V.batch_requests(spark, sf), S.formula_predictor(), V.AS_OF, keep=["request_id"]
    )
    return _shown(scored, "request_id", "name")


def batch_reply_counts(spark, sf):
    """Batch requests as JSON text in, reply envelopes out, without the range test.

    Some requests have no list, an empty list, places without coordinates, or are no JSON.
    """
    key, none = F.col("request_id"), F.lit(None)
    placeless = F.transform("locations", lambda e: F.struct(
        none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), e["name"].alias("name")))
    requests = V.batch_requests(spark, sf).withColumn("locations", F.when(key % 7 == 5, F.slice("locations", 1, 0)).when(
        key % 11 == 4, placeless).when(key % 7 != 3, F.col("locations")))
    bodies = requests.select("request_id", F.when(key % 13 == 6, F.lit("not JSON")).otherwise(
        F.to_json(F.struct(*BATCH_REQUEST.names))).alias("body"))
    batches = parse_requests(bodies, schema=BATCH_REQUEST, keep=["request_id"])
    scored = S.score_batches(
        batches, S.formula_predictor(), V.AS_OF, keep=["request_id"], range_check=False
    ).withColumn("position", F.struct("latitude", "longitude", "name"))
    replies = batch_replies(scored)
    total = F.aggregate("predictions", F.lit(0.0), lambda a, p: a + p["no2_value"] / 1e13)
    return replies.select("request_id", "success", "count", F.round(total, 5).alias("total"), "error")


def scenario_offsets(spark, sf):
    """Every order's place scored on its own weekday, and as weekday against weekend."""
    rows = V.obs_year(spark, sf)
    flags = rows.select(
        "event_id", "latitude", "longitude", F.month("time").alias("month"),
        F.dayofyear("time").alias("day_of_year"), F.explode(F.array(F.lit(0), F.lit(1))).alias("is_weekend"),
    )
    scored = S.score_requests(flags, S.formula_predictor("boxes"), V.AS_OF)
    return scored.groupBy("month").agg(
        F.round(F.avg(F.when(F.col("is_weekend") == 0, F.col("no2_value"))) / 1e13, 6).alias("weekday"),
        F.round(F.avg(F.when(F.col("is_weekend") == 1, F.col("no2_value"))) / 1e13, 6).alias("weekend"),
    )


def stream_flatten(spark, sf):
    """The embeddings table as a block stream, flattened to Parquet, then read."""
    source = V.table(spark, sf, "embeddings")
    # the table is a file or a folder of files, which a filter on file names would miss; a stream takes
    # a path to one file only as a pattern
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/embeddings[.]parquet")
    start = F.to_timestamp_ntz(F.lit("2023-08-01 00:00:00"))
    blocks = stream.select(
        "vec_id",
        F.array(F.timestamp_add("DAY", F.col("vec_id"), start)).alias("time"),
        F.expr(V.AXIS.format(n=8, origin="25.0")).alias("latitude"),
        F.expr(V.AXIS.format(n=8, origin="-125.0")).alias("longitude"),
        F.transform("embedding", lambda x: F.when(x >= -0.2, x)).alias("no2"),
    )
    out = work_path(spark, "stream-flatten")
    rows = P.flatten_stream(blocks, keep=["vec_id"])
    P.start(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(
        "vec_id", F.round("no2", 6).alias("no2"), "latitude", "longitude",
        F.date_format("time", "yyyy-MM-dd").alias("day"),
    )


def stream_score(spark, sf):
    """Requests written as JSON files, scored as a stream, then read."""
    out = work_path(spark, "stream-score")
    V.requests(spark, sf).write.json(f"{out}/requests")
    schema = T.StructType([T.StructField("event_id", T.LongType()), *SCORE_REQUEST.fields])
    stream = P.read_request_stream(spark, f"{out}/requests", schema)
    scored = P.score_stream(stream, S.formula_predictor(), V.AS_OF)
    P.start(scored, f"{out}/scored", f"{out}/checkpoint").awaitTermination()
    return _shown(spark.read.parquet(f"{out}/scored"), "event_id")


def number_texts(spark, sf):
    """Display texts of coordinates and values, read back as numbers."""
    rows = V.requests(spark, sf).select("event_id", F.abs("latitude").alias("x"), ((F.col("temperature") + 0.0012) * 1e14).alias("v"))
    return rows.select(
        "event_id", fixed3(F.col("x")).cast("double").alias("x"), scientific(F.col("v")).cast("double").alias("v"))


QUERIES = {
    "number_texts": number_texts,
    "score_validate": score_validate,
    "score_defaults": score_defaults,
    "score_requests": score_requests,
    "score_json": score_json,
    "batch_score": batch_score,
    "batch_reply_counts": batch_reply_counts,
    "scenario_offsets": scenario_offsets,
    "stream_flatten": stream_flatten,
    "stream_score": stream_score,
}

ERROR_SQL = """CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'latitude and longitude are required'
  WHEN NOT latitude BETWEEN 25 AND 50 THEN 'latitude must be between 25 and 50'
  WHEN NOT longitude BETWEEN -125 AND -65 THEN 'longitude must be between -125 and -65' END"""
FILLED = V.REQUESTS + f""", filled AS (
  SELECT event_id, name, latitude, longitude, {ERROR_SQL} AS error, coalesce(month, 1) AS month,
         coalesce(day_of_year, 20) AS day_of_year, coalesce(is_weekend, 1) AS is_weekend,
         coalesce(temperature, 25.0) AS temperature, coalesce(wind_speed, 10.0) AS wind_speed,
         coalesce(humidity, 60.0) AS humidity FROM requests)"""
NAMES = dict(lat="latitude", lon="longitude", doy="day_of_year", weekend="is_weekend", t="temperature", w="wind_speed")


def scored_sql(kind):
    sql = V.SMOOTH_SQL if kind == "smooth" else V.BOXES_SQL
    return FILLED + f""", scored AS (
  SELECT *, CASE WHEN error IS NULL THEN {sql.format(**NAMES)} END AS v FROM filled)"""


SCORED_COLUMNS = f"""round(v / 1e13, 6) AS no2_value, {V.CODE_SQL.format(x='v')} AS air_quality,
       {V.COLOUR_SQL.format(x='v')} AS color, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, error"""

_BATCH = V.REQUESTS + f""", located AS (
  SELECT event_id, event_id // 16 AS request_id, coalesce(name, 'Unknown') AS name, latitude, longitude, {ERROR_SQL} AS error,
         CASE WHEN (event_id // 16) % 3 <> 0 THEN (event_id // 16) % 365 + 1 ELSE 20 END AS day_of_year,
         CASE WHEN (event_id // 16) % 3 <> 0 THEN (event_id // 16) % 2 ELSE 1 END AS is_weekend
  FROM requests),
valued AS (SELECT *, {V.SMOOTH_SQL.format(**NAMES)} AS raw FROM located),
scored AS (SELECT *, CASE WHEN error IS NULL THEN raw END AS v FROM valued)"""

BATCH = "WITH " + _BATCH
# away from ties both roundings agree
_NUMBER_TEXTS = f"""WITH {V.REQUESTS} SELECT event_id, printf('%.3f', latitude)::double AS x,
  printf('%.2e', (temperature + 0.0012) * 1e14)::double AS v FROM requests"""

ORACLE = {
    "number_texts": _NUMBER_TEXTS,
    "score_validate": f"WITH {V.REQUESTS} SELECT event_id, {ERROR_SQL} AS error FROM requests",
    "score_defaults": f"""WITH {FILLED}
SELECT event_id, month, day_of_year, is_weekend, round(temperature, 6) AS temperature,
       round(wind_speed, 6) AS wind_speed, round(humidity, 6) AS humidity FROM filled""",
    "score_requests": f"WITH {scored_sql('smooth')} SELECT event_id, {SCORED_COLUMNS} FROM scored",
    "score_json": f"""WITH {scored_sql('boxes')}
SELECT event_id, error IS NULL AS success, round(v / 1e13, 6) AS no2_value,
       {V.CODE_SQL.format(x='v')} AS air_quality, error FROM scored""",
    "batch_score": f"WITH {_BATCH} SELECT request_id, name, {SCORED_COLUMNS} FROM scored",
    "batch_reply_counts": f"""WITH {_BATCH}
SELECT request_id, ok AS success, CASE WHEN ok THEN n END AS count, CASE WHEN ok THEN total END AS total,
       CASE WHEN NOT ok THEN 'locations array is required' END AS error
FROM (SELECT request_id, NOT (request_id % 13 = 6 OR (request_id % 7 = 3 AND request_id % 11 <> 4)) AS ok,
             count(raw) FILTER (request_id % 7 <> 5 AND request_id % 11 <> 4) AS n,
             coalesce(round(sum(raw / 1e13) FILTER (request_id % 7 <> 5 AND request_id % 11 <> 4), 5), 0) AS total
      FROM scored GROUP BY 1)""",
    "scenario_offsets": f"""WITH {V.OBS_YEAR}, flags AS (
  SELECT latitude, longitude, month(time) AS month, dayofyear(time) AS day_of_year, f AS is_weekend,
         25.0::double AS temperature, 10.0::double AS wind_speed FROM obs_year, (VALUES (0), (1)) w(f)),
scored AS (SELECT *, {V.BOXES_SQL.format(**NAMES)} AS v FROM flags)
SELECT month, round(avg(v) FILTER (is_weekend = 0) / 1e13, 6) AS weekday,
       round(avg(v) FILTER (is_weekend = 1) / 1e13, 6) AS weekend FROM scored GROUP BY 1""",
    "stream_flatten": f"""WITH {V.grid_sql()}
SELECT vec_id, round(no2, 6) AS no2, latitude, longitude, strftime(day, '%Y-%m-%d') AS day FROM flat""",
    "stream_score": f"WITH {scored_sql('smooth')} SELECT event_id, {SCORED_COLUMNS} FROM scored",
}
