"""Registered queries: splits and scaling."""

from pyspark.sql import functions as F

from nitrogrid.operators.scale import scale_features
from nitrogrid.operators.split import split_rows, split_rows_exact, split_sizes
from nitrogrid.plans.preprocessing import prepared_table
from nitrogrid.registry import views as V

SCALED = ["latitude", "longitude", "no2", "constant"]


def _rows(spark, sf):
    return V.obs(spark, sf).withColumns({"no2": F.col("no2") / 1e13, "constant": F.lit(7.0)})


def split_two_way(spark, sf):
    return split_rows(_rows(spark, sf), "event_id").select("event_id", "split")


def split_three_way(spark, sf):
    return split_rows(_rows(spark, sf), "event_id", 0.2, 0.2).select("event_id", "split")


def split_exact(spark, sf):
    return split_rows_exact(_rows(spark, sf), "event_id", 0.3).select("event_id", "split")


def sizes(spark, sf):
    return split_sizes(split_rows(_rows(spark, sf), "event_id", 0.2, 0.2))


def _scaled(spark, sf, kind):
    rows = split_rows(_rows(spark, sf), "event_id")
    table = scale_features(rows, SCALED, kind)
    return table.select("event_id", *[F.round(c, 6).alias(c) for c in SCALED])


def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


def prepared_features(spark, sf):
    """The whole preparation: features, three-way split, scaling on the training part."""
    table = prepared_table(V.obs(spark, sf), "event_id")
    return table.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.col(c) * F.col(c)), 5).alias(c) for c in ("latitude", "longitude", "hour", "day_of_year", "is_weekend", "season")],
        *[F.round(F.max(c), 5).alias(f"max_{c}") for c in ("distance_from_center", "day_of_week", "pressure")],
    )


QUERIES = {
    "split_two_way": split_two_way,
    "split_three_way": split_three_way,
    "split_exact": split_exact,
    "split_sizes": sizes,
    "scale_standard": scale_standard,
    "scale_minmax": scale_minmax,
    "prepared_features": prepared_features,
}

HASH_SQL = "('0x' || substr(md5('42:' || event_id), 1, 13))::bigint"
THREE_SQL = f"""CASE WHEN {HASH_SQL} / 4503599627370496.0::double < 0.2::double THEN 'test'
  WHEN {HASH_SQL} / 4503599627370496.0::double < 0.4::double THEN 'val' ELSE 'train' END"""
TWO_SQL = f"CASE WHEN {HASH_SQL} / 4503599627370496.0::double < 0.2::double THEN 'test' ELSE 'train' END"

_TRAIN = V.OBS + f""", r AS (
  SELECT event_id, latitude, longitude, no2 / 1e13::double AS no2, {TWO_SQL} AS split FROM obs),
t AS (SELECT * FROM r WHERE split = 'train')"""

ORACLE = {
    "split_two_way": f"SELECT event_id, {TWO_SQL} AS split FROM events",
    "split_three_way": f"SELECT event_id, {THREE_SQL} AS split FROM events",
    "split_exact": f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {HASH_SQL}, event_id)
  <= ceil((SELECT count(*) FROM events) * 0.3::double) THEN 'test' ELSE 'train' END AS split FROM events""",
    "split_sizes": f"SELECT {THREE_SQL} AS split, count(*) AS rows FROM events GROUP BY 1",
    "scale_standard": f"""WITH {_TRAIN}, s AS (
  SELECT avg(latitude) a, stddev_pop(latitude) b, avg(longitude) c, stddev_pop(longitude) d, avg(no2) e, stddev_pop(no2) f FROM t)
SELECT event_id, round((latitude - a) / b, 6) AS latitude, round((longitude - c) / d, 6) AS longitude,
       round((no2 - e) / f, 6) AS no2, 0.0::double AS constant FROM r, s""",
    "scale_minmax": f"""WITH {_TRAIN}, s AS (
  SELECT min(latitude) a, max(latitude) b, min(longitude) c, max(longitude) d, min(no2) e, max(no2) f FROM t)
SELECT event_id, round((latitude - a) / (b - a), 6) AS latitude, round((longitude - c) / (d - c), 6) AS longitude,
       round((no2 - e) / (f - e), 6) AS no2, 0.0::double AS constant FROM r, s""",
    "prepared_features": f"""WITH {V.OBS}, x AS (
  SELECT latitude, longitude, hour(time) AS hour, dayofyear(time) AS day_of_year, (isodow(time) >= 6)::int AS is_weekend,
         sqrt(pow(latitude - 40.0::double, 2) + pow(longitude + 100.0::double, 2)) AS dist,
         isodow(time) - 1 AS dow, {THREE_SQL} AS split FROM obs),
s AS (SELECT avg(latitude) la, stddev_pop(latitude) lb, avg(longitude) oa, stddev_pop(longitude) ob,
        avg(hour) ha, stddev_pop(hour) hb, avg(day_of_year) ya, stddev_pop(day_of_year) yb,
        avg(is_weekend) wa, stddev_pop(is_weekend) wb, avg(dist) da, stddev_pop(dist) db,
        avg(dow) ka, stddev_pop(dow) kb FROM x WHERE split = 'train')
SELECT split, count(*) AS n, round(avg(pow((latitude - la) / lb, 2)), 5) AS latitude,
       round(avg(pow((longitude - oa) / ob, 2)), 5) AS longitude, round(avg(pow((hour - ha) / hb, 2)), 5) AS hour,
       round(avg(pow((day_of_year - ya) / yb, 2)), 5) AS day_of_year,
       round(avg(pow((is_weekend - wa) / wb, 2)), 5) AS is_weekend, 0.0::double AS season,
       round(max((dist - da) / db), 5) AS max_distance_from_center,
       round(max((dow - ka) / kb), 5) AS max_day_of_week, 0.0::double AS max_pressure
FROM x, s GROUP BY split""",
}
