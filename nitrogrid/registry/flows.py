"""Registered queries: nearest observations, quality states, streams written by micro-batch."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.functions.calendar import is_weekend
from nitrogrid.operators import quality_states as Q
from nitrogrid.operators.nearest import nearest
from nitrogrid.plans import scoring as S
from nitrogrid.registry import scoring as RS
from nitrogrid.registry import views as V
from nitrogrid.schemas import BATCH_REQUEST, GRID_BLOCK, OBSERVATION
from nitrogrid.session import work_path
from nitrogrid.streaming import batches as B
from nitrogrid.streaming import pipelines as P

KEPT_FILES, ADDED, REMOVED, REWRITTEN = 50, 7, 3, 11


def _seen(spark, sf):
    """Observations with calendar and weather covariates; some have none."""
    rows, key = V.obs_year(spark, sf), F.col("event_id")
    return rows.select(
        "event_id", "latitude", "longitude", F.month("time").alias("month"), F.dayofyear("time").alias("day_of_year"),
        is_weekend(F.col("time")).alias("is_weekend"),
        F.when(key % 3 != 0, (key % 40).cast("double")).alias("temperature"), F.col("no2"))


def nearest_observation(spark, sf):
    """For each customer's place, off the observations' lattice, the nearest observation."""
    key = F.col("c_custkey")
    places = V.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 19 != 0, F.lit(25.0) + F.pmod(key * 37, F.lit(2503)) * F.lit(0.01)).alias("latitude"),
        F.when(key % 23 == 0, F.lit(float("nan"))).when(key % 29 == 0, F.lit(-20.0) + key % 7)
        .otherwise(F.lit(-125.0) + F.pmod(key * 53, F.lit(6007)) * F.lit(0.01)).alias("longitude"))
    found = nearest(places, _seen(spark, sf), "event_id", ["event_id", "no2"])
    return found.select("c_custkey", "event_id", V.scaled("no2"), F.round("distance", 9).alias("distance"))


def city_observations(spark, sf):
    """Cities and rural places scored with the covariates of their nearest observations."""
    placed = S.city_observations(spark, _seen(spark, sf), "event_id")
    scored = S.score_requests(placed, S.formula_predictor("boxes"), V.AS_OF)
    return scored.select("label", "event_id", F.round("distance", 9).alias("distance"), "month", "day_of_year",
                         "is_weekend", "temperature", "wind_speed", V.scaled("no2_value"), "air_quality")


def merged_quality(spark, sf):
    """States of files, of which one comes later, one is rewritten and one removed, merged into a report."""
    rows = V.obs_missing(spark, sf).withColumn("source_file", F.format_string("file_%02d", F.col("event_id") % KEPT_FILES))

    def file(n):
        return F.col("source_file") == f"file_{n:02d}"

    path = work_path(spark, "quality-states")
    first = rows.filter(~file(ADDED)).withColumn("no2", F.when(file(REWRITTEN), F.lit(9e20)).otherwise(F.col("no2")))
    Q.quality_states(first).write.parquet(f"{path}/first")
    Q.quality_states(rows.filter(file(ADDED) | file(REWRITTEN))).write.parquet(f"{path}/second")
    states = Q.replace_states(spark.read.parquet(f"{path}/first"), spark.read.parquet(f"{path}/second"))
    gone = rows.filter(file(REMOVED)).select("source_file").distinct()
    report = Q.merged_report(Q.without_files(states, gone))
    # the rows themselves only judge the sketches
    left = rows.filter(~file(REMOVED))
    median = report.select("median").scalar()
    value = F.when(~F.isnan("no2"), F.col("no2"))
    exact = left.agg(F.count_distinct("time").alias("times"), F.avg((value < median).cast("int")).alias("below"),
                     F.avg((value <= median).cast("int")).alias("upto"))
    return report.select(
        "total_samples", "missing_values", *[V.scaled(c) for c in ("mean", "std", "min", "max")],
        *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
        F.date_format("time_min", "yyyy-MM-dd HH:mm:ss").alias("time_min"),
        F.date_format("time_max", "yyyy-MM-dd HH:mm:ss").alias("time_max"),
        (F.abs(F.col("unique_times") / exact.select("times").scalar() - 1) < Q.DISTINCT_BOUND).alias("times_near"),
        ((exact.select("below").scalar() < 0.5 + Q.RANK_BOUND) & (exact.select("upto").scalar() > 0.5 - Q.RANK_BOUND))
        .alias("median_near"))


def stream_ingest(spark, sf):
    """Grid blocks, some of them unusable, ingested as a stream into rows, rejects and numbered files."""
    out, key = work_path(spark, "stream-ingest"), F.col("vec_id")
    blocks = V.grid(spark, sf).withColumn(
        "no2", F.when(key % 11 == 5, None).when(key % 7 == 3, F.slice("no2", 1, 60)).otherwise(F.col("no2")))
    blocks.repartition(4, "vec_id").select(*GRID_BLOCK.names).write.parquet(f"{out}/source")
    stream = P.read_block_stream(spark, f"{out}/source", files_per_trigger=2)
    B.start_ingest(stream, f"{out}/tables", f"{out}/checkpoint", mode="strict").awaitTermination()
    files = B.committed(spark, f"{out}/tables", "files", B.FILES).select(*B.FILES.names)
    rows = B.committed(spark, f"{out}/tables", "rows", OBSERVATION)
    rejects = B.committed(spark, f"{out}/tables", "rejects", B.REJECTS)
    points = rows.groupBy("source_file", "file_index").agg(F.count(F.lit(1)).alias("points"), F.sum("no2").alias("total"))
    last = files.agg(F.max("file_index")).scalar()
    distinct = files.agg(F.count_distinct("file_index")).scalar()
    return files.join(points, ["source_file", "file_index"], "left").join(
        rejects.select("source_file", "error"), "source_file", "left",
    ).select("source_file", F.coalesce("points", F.lit(0)).alias("points"), F.round("total", 4).alias("total"), "error",
             (distinct == last + 1).alias("gapless"))


def stream_replies(spark, sf):
    """Batch requests as a stream of JSON files; one reply for each, also without a list."""
    out, key = work_path(spark, "stream-replies"), F.col("request_id")
    requests = V.batch_requests(spark, sf).withColumn(
        "locations", F.when(key % 7 == 5, F.slice("locations", 1, 0)).when(key % 7 != 3, F.col("locations")))
    requests.repartition(4, "request_id").write.json(f"{out}/source")
    schema = T.StructType([T.StructField("request_id", T.LongType()), *BATCH_REQUEST.fields])
    stream = P.read_request_stream(spark, f"{out}/source", schema, files_per_trigger=2)
    B.start_replies(stream, f"{out}/tables", f"{out}/checkpoint", S.formula_predictor(), as_of=V.AS_OF).awaitTermination()
    reply = B.reply_schema(("request_id", T.LongType()))
    replies = B.committed(spark, f"{out}/tables", "replies", reply)
    total = F.aggregate("predictions", F.lit(0.0), lambda a, p: a + p["no2_value"] / 1e13)
    return replies.select(
        "request_id", "success", "count", F.round(total, 5).alias("total"),
        F.array_join(F.transform("predictions", lambda p: p["name"]), ",").alias("names"), "error")


QUERIES = {
    "nearest_observation": nearest_observation,
    "city_observations": city_observations,
    "merged_quality": merged_quality,
    "stream_ingest": stream_ingest,
    "stream_replies": stream_replies,
}

_SEEN = f"""{V.OBS_YEAR}, seen AS (
  SELECT event_id, latitude, longitude, month(time) AS month, dayofyear(time) AS day_of_year,
         (isodow(time) >= 6)::int AS is_weekend,
         CASE WHEN event_id % 3 <> 0 THEN (event_id % 40)::double END AS temperature, no2 FROM obs_year)"""


def _nearest_sql(places, key):
    """Brute force: every place against every observation."""
    return f"""near AS (
  SELECT * FROM (
    SELECT p.{key}, s.event_id, sqrt((s.latitude - p.lat) * (s.latitude - p.lat) + (s.longitude - p.lon) * (s.longitude - p.lon)) AS distance,
           s.month, s.day_of_year, s.is_weekend, s.temperature, s.no2,
           row_number() OVER (PARTITION BY p.{key} ORDER BY (s.latitude - p.lat) * (s.latitude - p.lat)
             + (s.longitude - p.lon) * (s.longitude - p.lon), s.event_id) AS r
    FROM {places} p, seen s WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL) WHERE r = 1)"""


_CITIES = ", ".join(f"('{name}', {lat}::double, {lon}::double)" for name, lat, lon, _ in S.K.CITY_SCENARIOS)
_BOXES = V.BOXES_SQL.format(lat="lat", lon="lon", doy="day_of_year", weekend="is_weekend", t="temperature", w="10.0::double")

ORACLE = {
    "nearest_observation": f"""WITH {_SEEN}, places AS (
  SELECT c_custkey, CASE WHEN c_custkey % 19 <> 0 THEN 25.0::double + ((c_custkey * 37) % 2503) * 0.01::double END AS lat,
         CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN -20.0::double + c_custkey % 7
              ELSE -125.0::double + ((c_custkey * 53) % 6007) * 0.01::double END AS lon FROM customer),
{_nearest_sql('places', 'c_custkey')}
SELECT c_custkey, event_id, round(no2 / 1e13, 6) AS no2, round(distance, 9) AS distance
FROM places LEFT JOIN near USING (c_custkey)""",
    "city_observations": f"""WITH {_SEEN}, places AS (SELECT * FROM (VALUES {_CITIES}) c(label, lat, lon)),
{_nearest_sql('places', 'label')},
placed AS (SELECT label, lat, lon, event_id, distance, month, day_of_year, is_weekend,
                  coalesce(temperature, 25.0::double) AS temperature FROM places JOIN near USING (label)),
scored AS (SELECT *, {_BOXES} AS v FROM placed)
SELECT label, event_id, round(distance, 9) AS distance, month, day_of_year, is_weekend, temperature,
       10.0::double AS wind_speed, round(v / 1e13, 6) AS no2_value, {V.CODE_SQL.format(x='v')} AS air_quality FROM scored""",
    "merged_quality": f"""WITH {V.OBS_MISSING}
SELECT count(*) AS total_samples, count(*) FILTER (no2 IS NULL) AS missing_values,
       round(avg(no2) / 1e13, 6) AS mean, round(stddev_samp(no2) / 1e13, 6) AS std,
       round(min(no2) / 1e13, 6) AS min, round(max(no2) / 1e13, 6) AS max,
       round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
       round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max,
       strftime(min(time), '%Y-%m-%d %H:%M:%S') AS time_min, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS time_max,
       true AS times_near, true AS median_near
FROM obs_missing WHERE event_id % {KEPT_FILES} <> {REMOVED}""",
    "stream_ingest": f"""WITH {V.grid_sql()}
SELECT printf('granule_%05d', e.vec_id) AS source_file,
       CASE WHEN e.vec_id % 11 = 5 OR e.vec_id % 7 = 3 THEN 0 ELSE coalesce(f.points, 0) END AS points,
       CASE WHEN e.vec_id % 11 = 5 OR e.vec_id % 7 = 3 THEN NULL ELSE round(f.total, 4) END AS total,
       CASE WHEN e.vec_id % 11 = 5 THEN 'missing variable: no2'
            WHEN e.vec_id % 7 = 3 THEN 'sizes of variables differ' END AS error, true AS gapless
FROM embeddings e LEFT JOIN (SELECT vec_id, count(*) AS points, sum(no2) AS total FROM flat GROUP BY 1) f USING (vec_id)""",
    "stream_replies": f"""{RS.BATCH}, named AS (
  SELECT request_id, event_id, name, v, error, request_id % 7 <> 3 AS ok, request_id % 7 NOT IN (3, 5) AND error IS NULL AS given
  FROM scored)
SELECT request_id, ok AS success, CASE WHEN ok THEN count(*) FILTER (given) END AS count,
       CASE WHEN ok THEN coalesce(round(sum(v / 1e13) FILTER (given), 5), 0) END AS total,
       CASE WHEN ok THEN coalesce(string_agg(name, ',' ORDER BY event_id) FILTER (given), '') END AS names,
       CASE WHEN NOT ok THEN 'locations array is required' END AS error
FROM named GROUP BY request_id, ok""",
}
