"""Registered queries: features, quality, field model, classes."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.field import box_response, expected_field, smooth_response
from nitrogrid.functions.calendar import date_spine, is_weekend
from nitrogrid.functions.geo import box_weight, cell_index, hotspot_influence
from nitrogrid.operators.boxes import first_box
from nitrogrid.operators import quality
from nitrogrid.operators.air_quality import classify, with_display
from nitrogrid.operators.features import (
    model_features, select_features, spatial_features, temporal_features, weather_features,
)
from nitrogrid.operators.grid import regular_grid
from nitrogrid.operators.metrics import regression_metrics, with_verdict
from nitrogrid.operators.missing import drop_missing, missing_summary
from nitrogrid.plans.preprocessing import feature_table
from nitrogrid.registry import views as V

CALENDAR = ["year", "month", "day", "hour", "day_of_year", "day_of_week", "is_weekend", "season"]
REGION = ["distance_from_center", "is_east_coast", "is_west_coast", "is_northern", "is_southern"]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def air_quality_by_season(rows):
    featured = spatial_features(temporal_features(drop_missing(rows)))
    return classify(featured, "no2").groupBy("season", "air_quality").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("no2") / 1e13, 6).alias("mean_no2"),
        F.round(F.avg("distance_from_center"), 6).alias("mean_distance"),
        F.sum("is_weekend").alias("weekend_rows"),
    )


def flagship_air_quality(spark, sf):
    return air_quality_by_season(V.obs_year(spark, sf))


def temporal_features_orders(spark, sf):
    return temporal_features(V.obs_year(spark, sf)).select("event_id", *CALENDAR)


def temporal_features_events(spark, sf):
    return temporal_features(V.obs(spark, sf)).select("event_id", *CALENDAR)


def spatial_features_events(spark, sf):
    return rounded(spatial_features(V.obs(spark, sf)).select("event_id", *REGION), REGION[0])


def model_features_orders(spark, sf):
    rows = V.obs_year(spark, sf).withColumn("date", F.to_date("time"))
    table = select_features(model_features(rows), K.MODEL_FEATURES, keys=["event_id"])
    table = table.withColumn("label", F.col("label") / 1e13)
    return rounded(table, "latitude", "longitude", "distance_from_center", "temperature",
                   "lat_lon_interaction", "temp_humidity_interaction", "label")


def preprocessing_features(spark, sf):
    table = feature_table(V.obs(spark, sf), "event_id").withColumn("label", F.col("label") / 1e13)
    return rounded(table, "latitude", "longitude", "distance_from_center", "temperature", "label")


def quality_report(spark, sf):
    report = quality.quality_report(V.obs_missing(spark, sf))
    return report.select(
        "total_samples", "missing_values",
        *[V.scaled(c) for c in ("mean", "std", "min", "max", "median")],
        *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
        F.date_format("time_min", "yyyy-MM-dd HH:mm:ss").alias("time_min"),
        F.date_format("time_max", "yyyy-MM-dd HH:mm:ss").alias("time_max"),
        "unique_times",
    )


def describe_numeric(spark, sf):
    rows = V.obs_missing(spark, sf).withColumn("no2", F.col("no2") / 1e13)
    table = quality.describe(rows, ["event_id", "latitude", "longitude", "no2"])
    return rounded(table, "mean", "std", "min", "p25", "p50", "p75", "max")


def value_range(spark, sf):
    return quality.value_range(V.obs_missing(spark, sf)).select(V.scaled("min"), V.scaled("max"))


def points_per_file(spark, sf):
    return quality.points_per_file(V.obs(spark, sf))


def drop_missing_rows(spark, sf):
    return drop_missing(V.obs_missing(spark, sf)).select("event_id", V.scaled("no2"))


def missing_counts(spark, sf):
    return missing_summary(V.obs_missing(spark, sf))


def hotspot_influence_events(spark, sf):
    return V.obs(spark, sf).select(
        "event_id", V.scaled(hotspot_influence(F.col("latitude"), F.col("longitude")), "influence")
    )


def box_table(spark, sf):
    """Boxes of all sizes from the suppliers: some overlap, some are points, one covers the whole field."""
    n = F.col("s_suppkey")
    low = F.lit(25.0) + F.pmod(n * 37, F.lit(250)) * F.lit(0.1)
    left = F.lit(-125.0) + F.pmod(n * 91, F.lit(600)) * F.lit(0.1)
    return V.table(spark, sf, "supplier").select(
        F.pmod(n * 13, F.lit(10007)).alias("priority"), low.alias("lat_lo"), left.alias("lon_lo"),
        F.when(n % 50 == 3, F.lit(50.0)).otherwise(low + F.pmod(n, F.lit(7)) * F.lit(0.5)).alias("lat_hi"),
        (left + F.pmod(n, F.lit(11)) * F.lit(0.9)).alias("lon_hi"), F.col("s_acctbal").alias("weight"))


def box_table_weight(spark, sf):
    """For each observation the first of the table's boxes that holds it."""
    return first_box(V.obs(spark, sf), box_table(spark, sf), "event_id").select("event_id", "priority", "weight")


def box_weight_events(spark, sf):
    return V.obs(spark, sf).select(
        "event_id", box_weight(F.col("latitude"), F.col("longitude")).alias("weight")
    )


def expected_field_orders(spark, sf):
    rows = temporal_features(V.obs_year(spark, sf))
    value = expected_field(*[F.col(c) for c in ("latitude", "longitude", "day_of_year", "is_weekend")])
    return rows.select("event_id", V.scaled(value, "expected"))


def expected_field_daily(spark, sf):
    """Field on a 5-degree grid for every day between the first and last order, per day."""
    span = V.table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("d0"), F.to_date(F.max("o_orderdate")).alias("d1")
    )
    days = span.select(F.explode(date_spine(F.col("d0"), F.col("d1"))).alias("date"))
    grid = regular_grid(days, 5.0)
    value = expected_field(
        F.col("latitude"), F.col("longitude"), F.dayofyear("date"), is_weekend(F.col("date"))
    )
    return grid.withColumn("v", value).groupBy("date").agg(
        F.count(F.lit(1)).alias("cells"),
        F.round(F.avg("v") / 1e13, 6).alias("mean"),
        F.round(F.min("v") / 1e13, 6).alias("min"),
        F.round(F.max("v") / 1e13, 6).alias("max"),
    ).withColumn("date", F.col("date").cast("string"))


def response_smooth(spark, sf):
    rows = temporal_features(V.obs(spark, sf))
    value = smooth_response(*[F.col(c) for c in ("latitude", "longitude", "day_of_year", "is_weekend")])
    return rows.select("event_id", V.scaled(value, "response"))


def response_boxes(spark, sf):
    rows = temporal_features(V.obs(spark, sf)).withColumns({
        "t": F.col("no2") / 1e13 % 40, "w": F.col("no2") / 1e13 % 30,
    })
    value = box_response(*[
        F.col(c) for c in ("latitude", "longitude", "day_of_year", "is_weekend", "t", "w")
    ])
    return rows.select("event_id", V.scaled(value, "response"))


def air_quality_classes(spark, sf):
    shown = with_display(classify(V.obs_missing(spark, sf), "no2"))
    return shown.select(
        "event_id", "air_quality", "air_quality_text", "color", "display_name", "display_colour", "emoji"
    )


def metrics_by_group(spark, sf):
    """Five groups of predictions, each with more error than the one before."""
    rows = temporal_features(V.obs(spark, sf))
    label = smooth_response(*[F.col(c) for c in ("latitude", "longitude", "day_of_year", "is_weekend")])
    group = F.col("event_id") % 5
    judged = rows.select(
        group.alias("grp"), label.alias("label"),
        (label + group * (F.col("no2") - 5e14) * 0.07).alias("prediction"),
    )
    table = with_verdict(regression_metrics(judged, by=["grp"]))
    return table.select(
        "grp", "n", F.round("r2", 6).alias("r2"), V.scaled("rmse"), V.scaled("mae"), "level", "passed"
    )


def weather_enriched(spark, sf):
    """Daily weather that begins half a month later; the days before it use the fallbacks."""
    rows = V.obs(spark, sf).withColumns({
        "date": F.to_date("time"), "day_of_year": F.dayofyear("time"),
    })
    weather = V.table(spark, sf, "events").select(
        F.date_add(F.to_date("ts"), 15).alias("date"), (F.col("value") / 4).alias("temperature"),
        (F.col("value") % 20).alias("wind_speed"),
    )
    joined = weather_features(rows, weather)
    return joined.select("event_id", *[
        F.round(c, 6).alias(c) for c in ("temperature", "wind_speed", "humidity", "pressure")
    ])


def weather_by_cell(spark, sf):
    """Weather by day and integer cell of a coarser grid, a day later than it was observed."""
    def cell(name, origin):
        return cell_index(F.col(name), origin, 0.7)

    rows = V.obs(spark, sf).withColumns({
        "date": F.to_date("time"), "day_of_year": F.dayofyear("time"),
        "cell_lat": cell("latitude", 25.0), "cell_lon": cell("longitude", -125.0),
    })
    weather = rows.select(
        F.date_add("date", 1).alias("date"), "cell_lat", "cell_lon", (F.col("no2") / 1e13 / 4).alias("temperature"))
    joined = weather_features(rows, weather, on=("date", "cell_lat", "cell_lon"))
    return joined.select("event_id", F.round("temperature", 6).alias("temperature"), "wind_speed")


QUERIES = {
    "weather_by_cell": weather_by_cell,
    "flagship_air_quality": flagship_air_quality,
    "temporal_features": temporal_features_orders,
    "temporal_features_hourly": temporal_features_events,
    "spatial_features": spatial_features_events,
    "model_features": model_features_orders,
    "preprocessing_features": preprocessing_features,
    "quality_report": quality_report,
    "describe_numeric": describe_numeric,
    "value_range": value_range,
    "points_per_file": points_per_file,
    "drop_missing": drop_missing_rows,
    "missing_counts": missing_counts,
    "hotspot_influence": hotspot_influence_events,
    "box_weight": box_weight_events,
    "box_table_weight": box_table_weight,
    "expected_field": expected_field_orders,
    "expected_field_daily": expected_field_daily,
    "response_smooth": response_smooth,
    "response_boxes": response_boxes,
    "air_quality_classes": air_quality_classes,
    "metrics_by_group": metrics_by_group,
    "weather_enriched": weather_enriched,
}

CALENDAR_SQL = """year(time) AS year, month(time) AS month, day(time) AS day, hour(time) AS hour,
  dayofyear(time) AS day_of_year, isodow(time) - 1 AS day_of_week,
  (isodow(time) >= 6)::int AS is_weekend, ((month(time) % 12) // 3) AS season"""
DISTANCE_SQL = "sqrt(pow(latitude - 40.0::double, 2) + pow(longitude + 100.0::double, 2))"
REGION_SQL = f"""round({DISTANCE_SQL}, 6) AS distance_from_center,
  (longitude > -80)::int AS is_east_coast, (longitude < -120)::int AS is_west_coast,
  (latitude > 40)::int AS is_northern, (latitude < 30)::int AS is_southern"""
BASELINE_SQL = "(20.0::double + 10.0::double * sin(2 * pi() * dayofyear(time) / 365))"
INFLUENCE_SQL = "(" + " + ".join(
    f"{intensity!r}::double * exp(-sqrt(pow(latitude - {lat!r}::double, 2) + pow(longitude - ({lon!r}::double), 2)) / 2.0::double)"
    for lat, lon, intensity in K.HOTSPOTS
) + ")"
EXPECTED_SQL = f"""greatest({INFLUENCE_SQL}
  * (1.0::double + 0.3::double * sin(2 * pi() * (dayofyear(time) - 80) / 365))
  * (CASE WHEN isodow(time) >= 6 THEN 0.8::double ELSE 1.0::double END), 1e14::double)"""
SMOOTH_OBS = V.SMOOTH_SQL.format(
    lat="latitude", lon="longitude", doy="dayofyear(time)", weekend="(isodow(time) >= 6)::int"
)

ORACLE = {
    "weather_by_cell": f"""WITH {V.OBS}, placed AS (
  SELECT *, round((latitude - 25.0::double) / 0.7::double)::int AS i, round((longitude + 125.0::double) / 0.7::double)::int AS j FROM obs),
weather AS (SELECT time::date + 1 AS date, i, j, avg(no2 / 1e13 / 4) AS temperature FROM placed GROUP BY ALL)
SELECT event_id, round(coalesce(w.temperature, {BASELINE_SQL}), 6) AS temperature, 10.0::double AS wind_speed
FROM placed p LEFT JOIN weather w ON p.time::date = w.date AND p.i = w.i AND p.j = w.j""",
    "flagship_air_quality": f"""WITH {V.OBS_YEAR}
SELECT ((month(time) % 12) // 3) AS season, {V.CODE_SQL.format(x='no2')} AS air_quality,
       count(*) AS n, round(avg(no2) / 1e13, 6) AS mean_no2,
       round(avg({DISTANCE_SQL}), 6) AS mean_distance,
       sum((isodow(time) >= 6)::int)::bigint AS weekend_rows
FROM obs_year GROUP BY 1, 2""",
    "temporal_features": f"WITH {V.OBS_YEAR} SELECT event_id, {CALENDAR_SQL} FROM obs_year",
    "temporal_features_hourly": f"WITH {V.OBS} SELECT event_id, {CALENDAR_SQL} FROM obs",
    "spatial_features": f"WITH {V.OBS} SELECT event_id, {REGION_SQL} FROM obs",
    "model_features": f"""WITH {V.OBS_YEAR}
SELECT event_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
       year(time) AS year, month(time) AS month, day(time) AS day, dayofyear(time) AS day_of_year,
       isodow(time) - 1 AS day_of_week, (isodow(time) >= 6)::int AS is_weekend, {REGION_SQL},
       round({BASELINE_SQL}, 6) AS temperature, 10.0::double AS wind_speed, 60.0::double AS humidity,
       1013.0::double AS pressure, round(latitude * longitude, 6) AS lat_lon_interaction,
       round({BASELINE_SQL} * 60.0::double, 6) AS temp_humidity_interaction,
       round(no2 / 1e13, 6) AS label
FROM obs_year""",
    "preprocessing_features": f"""WITH {V.OBS}
SELECT event_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
       {CALENDAR_SQL}, {REGION_SQL},
       round({BASELINE_SQL}, 6) AS temperature, 10.0::double AS wind_speed, 60.0::double AS humidity,
       1013.0::double AS pressure, round(no2 / 1e13, 6) AS label
FROM obs""",
    "quality_report": f"""WITH {V.OBS_MISSING}
SELECT count(*) AS total_samples, count(*) FILTER (no2 IS NULL) AS missing_values,
       round(avg(no2) / 1e13, 6) AS mean, round(stddev_samp(no2) / 1e13, 6) AS std,
       round(min(no2) / 1e13, 6) AS min, round(max(no2) / 1e13, 6) AS max,
       round(median(no2) / 1e13, 6) AS median,
       round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
       round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max,
       strftime(min(time), '%Y-%m-%d %H:%M:%S') AS time_min,
       strftime(max(time), '%Y-%m-%d %H:%M:%S') AS time_max,
       count(DISTINCT time) AS unique_times
FROM obs_missing""",
    "describe_numeric": f"WITH {V.OBS_MISSING} " + " UNION ALL ".join(f"""
SELECT '{name}' AS "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
       round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75,
       round(max(x), 6) AS max
FROM (SELECT ({expr})::double AS x FROM obs_missing)""" for name, expr in [
        ("event_id", "event_id"), ("latitude", "latitude"), ("longitude", "longitude"),
        ("no2", "no2 / 1e13::double")]),
    "value_range": f"""WITH {V.OBS_MISSING}
SELECT round(min(no2) / 1e13, 6) AS min, round(max(no2) / 1e13, 6) AS max FROM obs_missing""",
    "points_per_file": f"""WITH {V.OBS}
SELECT CASE WHEN grouping(source_file) = 1 THEN 'TOTAL' ELSE source_file END AS source_file,
       count(*) AS points FROM obs GROUP BY ROLLUP (source_file)""",
    "drop_missing": f"""WITH {V.OBS_MISSING}
SELECT event_id, round(no2 / 1e13, 6) AS no2 FROM obs_missing WHERE no2 IS NOT NULL""",
    "missing_counts": f"""WITH {V.OBS_MISSING}
SELECT count(*) AS rows, count(no2) AS kept, count(*) - count(no2) AS removed,
       count(*) - count(no2) AS missing_cells FROM obs_missing""",
    "hotspot_influence": f"""WITH {V.OBS}
SELECT event_id, round({INFLUENCE_SQL} / 1e13, 6) AS influence FROM obs""",
    "box_table_weight": f"""WITH {V.OBS}, lows AS (
  SELECT s_suppkey AS n, (s_suppkey * 13) % 10007 AS priority, s_acctbal AS weight,
         25.0::double + ((s_suppkey * 37) % 250) * 0.1::double AS lat_lo, -125.0::double + ((s_suppkey * 91) % 600) * 0.1::double AS lon_lo
  FROM supplier),
boxes AS (SELECT *, CASE WHEN n % 50 = 3 THEN 50.0::double ELSE lat_lo + (n % 7) * 0.5::double END AS lat_hi,
                 lon_lo + (n % 11) * 0.9::double AS lon_hi FROM lows)
SELECT event_id, min(priority) AS priority, arg_min(weight, priority) AS weight
FROM obs LEFT JOIN boxes ON latitude BETWEEN lat_lo AND lat_hi AND longitude BETWEEN lon_lo AND lon_hi GROUP BY event_id""",
    "box_weight": f"""WITH {V.OBS}
SELECT event_id, CASE WHEN latitude BETWEEN 40 AND 41 AND longitude BETWEEN -75 AND -73 THEN 2.0::double
       WHEN latitude BETWEEN 33 AND 35 AND longitude BETWEEN -119 AND -117 THEN 1.8::double
       WHEN latitude BETWEEN 41 AND 42 AND longitude BETWEEN -88 AND -87 THEN 1.6::double
       ELSE 0.0::double END AS weight FROM obs""",
    "expected_field": f"""WITH {V.OBS_YEAR}
SELECT event_id, round({EXPECTED_SQL} / 1e13, 6) AS expected FROM obs_year""",
    "expected_field_daily": f"""WITH span AS (
  SELECT min(o_orderdate)::date AS d0, max(o_orderdate)::date AS d1 FROM orders),
days AS (SELECT unnest(generate_series(d0, d1, INTERVAL 1 DAY))::timestamp AS time FROM span),
grid AS (SELECT time, 25.0::double + i * 5.0::double AS latitude, -125.0::double + j * 5.0::double AS longitude
  FROM days, range(6) a(i), range(13) b(j)),
field AS (SELECT time, {EXPECTED_SQL} AS v FROM grid)
SELECT strftime(time, '%Y-%m-%d') AS date, count(*) AS cells, round(avg(v) / 1e13, 6) AS mean,
       round(min(v) / 1e13, 6) AS min, round(max(v) / 1e13, 6) AS max FROM field GROUP BY 1""",
    "response_smooth": f"""WITH {V.OBS}
SELECT event_id, round(({SMOOTH_OBS}) / 1e13, 6) AS response FROM obs""",
    "response_boxes": f"""WITH {V.OBS}
SELECT event_id, round({V.BOXES_SQL.format(
        lat='latitude', lon='longitude', doy='dayofyear(time)', weekend='(isodow(time) >= 6)::int',
        t='(no2 / 1e13::double % 40)', w='(no2 / 1e13::double % 30)')} / 1e13, 6) AS response FROM obs""",
    "air_quality_classes": f"""WITH {V.OBS_MISSING}, coded AS (
  SELECT event_id, {V.CODE_SQL.format(x='no2')} AS air_quality, {V.COLOUR_SQL.format(x='no2')} AS color
  FROM obs_missing),
dim AS (SELECT * FROM (VALUES ('CLEAN_AIR', 'Clean Air', 'green', '✅'), ('LOW_POLLUTION', 'Low Pollution', 'yellow', '🟢'),
  ('MODERATE_POLLUTION', 'Moderate Pollution', 'orange', '🟡'), ('HIGH_POLLUTION', 'High Pollution', 'red', '🔴')) d(code, shown, colour, face))
SELECT event_id, air_quality, shown AS air_quality_text, color, shown AS display_name,
       coalesce(colour, 'primary') AS display_colour, coalesce(face, '{K.UNKNOWN_EMOJI}') AS emoji
FROM coded LEFT JOIN dim ON air_quality = code""",
    "metrics_by_group": f"""WITH {V.OBS}, judged AS (
  SELECT event_id % 5 AS grp, {SMOOTH_OBS} AS y, (event_id % 5) * (no2 - 5e14::double) * 0.07::double AS e FROM obs),
scored AS (SELECT grp, count(*) AS n, 1 - avg(e * e) / var_pop(y) AS r2, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae
  FROM judged GROUP BY grp)
SELECT grp, n, round(r2, 6) AS r2, round(rmse / 1e13, 6) AS rmse, round(mae / 1e13, 6) AS mae,
       CASE WHEN r2 > 0.95 THEN 'EXCELLENT' WHEN r2 > 0.9 THEN 'VERY GOOD' WHEN r2 > 0.8 THEN 'GOOD'
            WHEN r2 > 0.7 THEN 'FAIR' ELSE 'NEEDS IMPROVEMENT' END AS level, r2 > 0.8 AS passed
FROM scored""",
    "weather_enriched": f"""WITH {V.OBS}, weather AS (
  SELECT ts::date + 15 AS date, avg(value / 4) AS temperature, avg(value % 20) AS wind_speed
  FROM events GROUP BY 1)
SELECT event_id, round(coalesce(w.temperature, {BASELINE_SQL}), 6) AS temperature,
       round(coalesce(w.wind_speed, 10.0::double), 6) AS wind_speed,
       60.0::double AS humidity, 1013.0::double AS pressure
FROM obs LEFT JOIN weather w ON time::date = w.date""",
}
