"""Registered queries: grid blocks, flattening, dense grids, lineage."""

from pyspark.sql import functions as F

from nitrogrid.operators import declared as A
from nitrogrid.operators import densify as D
from nitrogrid.operators import grid as G
from nitrogrid.operators.lineage import union_all, with_file_index
from nitrogrid.operators.quality import distinct_values
from nitrogrid.registry import views as V
from nitrogrid.session import work_path
from nitrogrid.sinks.grids import write_declared_grid
from nitrogrid.sources.granules import read_blocks

POINT = ["no2", "latitude", "longitude"]
BOX = (26.5, 30.0, -124.0, -119.5)


def _points(rows, *keep):
    return rows.select(
        *keep, F.round("no2", 6).alias("no2"), "latitude", "longitude",
        F.date_format("time", "yyyy-MM-dd").alias("day"),
    )


def flatten_grid(spark, sf):
    return _points(G.flatten_grid(V.grid(spark, sf), keep=["vec_id"]), "vec_id")


def flatten_steps(spark, sf):
    """Two time steps of 4 x 8 points per block."""
    return _points(G.flatten_grid(V.grid(spark, sf, 2, 4, 8), keep=["vec_id"]), "vec_id")


def flatten_bbox(spark, sf):
    rows = G.flatten_grid(V.grid(spark, sf, 2, 4, 8), bbox=BOX, keep=["vec_id"])
    return _points(rows, "vec_id")


def flatten_tiles(spark, sf):
    """Blocks cut into latitude bands, bands outside the box skipped, then flattened."""
    tiles = G.tiles_in_box(G.tile_blocks(V.grid(spark, sf, 2, 4, 8), 2, keep=["vec_id"]), BOX)
    return _points(G.flatten_grid(tiles, bbox=BOX, keep=["vec_id"]), "vec_id")


def flatten_lenient(spark, sf):
    """Blocks that lack a variable keep the others."""
    key = F.col("vec_id")
    blocks = V.grid(spark, sf).withColumns({
        "no2": F.when(key % 7 != 0, F.col("no2")),
        "time": F.when(key % 5 != 0, F.col("time")),
    })
    return _points(G.flatten_grid(blocks, "lenient", keep=["vec_id"]), "vec_id")


def _damaged(spark, sf):
    key = F.col("vec_id")
    return V.grid(spark, sf).withColumns({
        "no2": F.when(key % 11 == 0, F.slice("no2", 1, 60)).when(key % 7 != 0, F.col("no2")),
        "time": F.when(key % 5 != 0, F.col("time")),
    })


def block_validation(spark, sf):
    return G.rejected_blocks(G.validate_blocks(_damaged(spark, sf)))


def variable_aliases(spark, sf):
    """Blocks whose variables have other accepted names."""
    blocks = V.grid(spark, sf).withColumnsRenamed({"latitude": "lat", "longitude": "lon", "no2": "NO2"})
    rows = G.flatten_grid(G.extract_variables(blocks))
    return rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("no2"), 5).alias("total"),
        F.min("latitude").alias("lat_min"), F.max("longitude").alias("lon_max"),
    )


def dataset_structure(spark, sf):
    rows = G.dataset_structure(V.grid(spark, sf, 2, 4, 8))
    return rows.select(
        "source_file", "kind", "name", "shape", "dtype",
        F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
        .alias("attrs"),
    )


def grid_round_trip(spark, sf):
    """Flatten, put the rows back in arrays, compare with the input."""
    blocks = V.grid(spark, sf)
    rows = G.flatten_grid(blocks, keep=["vec_id"], drop=False)
    placed = rows.withColumn(
        "position", ((F.col("latitude") - 25) * 8 + F.col("longitude") + 125).cast("int")
    )
    rebuilt = D.rows_to_blocks(placed, "vec_id").select(
        "vec_id", F.transform("no2", lambda x: x.cast("float")).alias("rebuilt")
    )
    return blocks.join(rebuilt, "vec_id").select(
        "vec_id", F.col("no2").eqNullSafe(F.col("rebuilt")).alias("same"), F.size("rebuilt").alias("n")
    )


def gridded(spark, sf):
    snapped = D.snap(V.obs(spark, sf), step=5.0)
    return snapped.withColumns({"date": F.to_date("time"), "no2": F.col("no2") / 1e13})


def axis_values(spark, sf):
    return distinct_values(V.obs(spark, sf).select(F.round("latitude", 6).alias("latitude")), "latitude")


def grid_spine(spark, sf):
    return D.grid_frame(gridded(spark, sf)).withColumn("date", F.col("date").cast("string"))


def densify_grid(spark, sf):
    return D.densify(gridded(spark, sf)).select(
        F.col("date").cast("string").alias("date"), "latitude", "longitude", F.round("no2", 6).alias("no2")
    )


def dense_tiles(spark, sf):
    """Dense tiles of two latitude rows, flattened again: the gridded sink's content."""
    tiles = D.dense_tiles(gridded(spark, sf), rows_per_tile=2)
    rows = G.flatten_grid(tiles, keep=["source_file", "lat_offset"])
    return rows.select("source_file", "lat_offset", "latitude", "longitude", F.round("no2", 2).alias("no2"))


LAT_AXIS, LON_AXIS = A.Axis.between(25.0, 50.0, 2.5), A.Axis.between(-125.0, -65.0, 5.0)


def dated(spark, sf):
    return V.obs(spark, sf).withColumns({"date": F.to_date("time"), "no2": F.col("no2") / 1e13})


def declared_grid(spark, sf):
    """Every cell of declared axes for each date, through tiles of four latitude rows; also bands without any row."""
    tiles = A.declared_tiles(dated(spark, sf), LAT_AXIS, LON_AXIS, rows_per_tile=4)
    return A.tile_cells(tiles, LAT_AXIS, LON_AXIS).select(
        F.col("date").cast("string").alias("date"), "lat_index", "lon_index", "latitude", "longitude",
        F.round("no2", 6).alias("no2"))


def declared_grid_sink(spark, sf):
    """Tiles over declared axes written as blocks by day, a day written a second time, read and flattened."""
    path = work_path(spark, "declared-grid")
    rows = dated(spark, sf).filter(F.col("latitude") < 30)
    write_declared_grid(rows, path, LAT_AXIS, LON_AXIS, rows_per_tile=4)
    again = rows.filter(F.dayofmonth("date") % 2 == 0).withColumn("no2", F.col("no2") + 1)
    write_declared_grid(again, path, LAT_AXIS, LON_AXIS, rows_per_tile=4)
    blocks = read_blocks(spark, path)
    return G.flatten_grid(G.valid_blocks(blocks), keep=["source_file"]).select(
        "source_file", "latitude", "longitude", F.round("no2", 2).alias("no2"))


def off_grid_rows(spark, sf):
    """Observations that a smaller grid does not hold."""
    small = A.Axis.between(25.0, 30.0, 2.5), A.Axis.between(-120.0, -70.0, 5.0)
    return A.off_grid(dated(spark, sf), *small).groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def lineage_union(spark, sf):
    """Rows of two unlike frames with the position of their file in the file list."""
    rows = V.obs(spark, sf)
    late = rows.filter(F.col("latitude") >= 37).drop("longitude")
    early = rows.filter(F.col("latitude") < 37)
    both = union_all([early, late])
    return with_file_index(both).select(
        "event_id", "source_file", "file_index", F.round("longitude", 6).alias("longitude")
    )


def flatten_bbox_lenient(spark, sf):
    """A box over blocks of which some have no time and some no values."""
    blocks = V.grid(spark, sf).withColumns({
        "time": F.when(F.col("vec_id") % 3 != 0, F.col("time")), "no2": F.when(F.col("vec_id") % 5 != 0, F.col("no2"))})
    rows = G.flatten_grid(blocks, "lenient", bbox=(26.0, 28.0, -124.0, -121.0), keep=["vec_id"])
    return rows.select("vec_id", F.round("no2", 6).alias("no2"), "latitude", "longitude",
                       F.date_format("time", "yyyy-MM-dd").alias("day"))


QUERIES = {
    "flatten_bbox_lenient": flatten_bbox_lenient,
    "flatten_grid": flatten_grid,
    "flatten_steps": flatten_steps,
    "flatten_bbox": flatten_bbox,
    "flatten_tiles": flatten_tiles,
    "flatten_lenient": flatten_lenient,
    "block_validation": block_validation,
    "variable_aliases": variable_aliases,
    "dataset_structure": dataset_structure,
    "grid_round_trip": grid_round_trip,
    "axis_values": axis_values,
    "grid_spine": grid_spine,
    "densify_grid": densify_grid,
    "dense_tiles": dense_tiles,
    "lineage_union": lineage_union,
    "declared_grid": declared_grid,
    "declared_grid_sink": declared_grid_sink,
    "off_grid_rows": off_grid_rows,
}

FLAT = "vec_id, round(no2, 6) AS no2, latitude, longitude, strftime(day, '%Y-%m-%d') AS day"
BOXED = f"latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}"
GRIDDED = V.OBS + """, gridded AS (
  SELECT event_id, time::date AS date, floor(latitude / 5.0::double) * 5.0::double AS latitude,
         floor(longitude / 5.0::double) * 5.0::double AS longitude, no2 / 1e13::double AS no2
  FROM obs),
lats AS (SELECT latitude, row_number() OVER (ORDER BY latitude) - 1 AS lat_index FROM (SELECT DISTINCT latitude FROM gridded)),
lons AS (SELECT longitude, row_number() OVER (ORDER BY longitude) - 1 AS lon_index FROM (SELECT DISTINCT longitude FROM gridded)),
spine AS (SELECT * FROM (SELECT DISTINCT date FROM gridded), lats, lons),
dense AS (SELECT spine.*, coalesce(c.no2, 0.0) AS no2 FROM spine LEFT JOIN (
  SELECT date, latitude, longitude, arg_max(no2, event_id) AS no2 FROM gridded GROUP BY ALL) c
  USING (date, latitude, longitude))"""


def _declared(rows):
    return f"""WITH {V.OBS}, dated AS (SELECT event_id, time::date AS date, latitude, longitude, no2 / 1e13::double AS no2 FROM obs),
rows AS ({rows}),
placed AS (SELECT date, floor((latitude - 25.0::double) / 2.5::double)::int AS lat_index,
                  floor((longitude + 125.0::double) / 5.0::double)::int AS lon_index, arg_max(no2, event_id) AS no2
           FROM rows WHERE latitude < 52.5::double AND longitude < -60.0::double GROUP BY ALL),
dense AS (SELECT f.date, f.lat_index, f.lon_index, 25.0::double + f.lat_index * 2.5::double AS latitude,
                 -125.0::double + f.lon_index * 5.0::double AS longitude, coalesce(p.no2, 0.0::double) AS no2
          FROM (SELECT d.date, a.i AS lat_index, b.j AS lon_index FROM (SELECT DISTINCT date FROM rows) d,
                       (SELECT unnest(range(11)) AS i) a, (SELECT unnest(range(13)) AS j) b) f
          LEFT JOIN placed p USING (date, lat_index, lon_index))"""


ORACLE = {
    "declared_grid": f"""{_declared("SELECT * FROM dated")}
SELECT strftime(date, '%Y-%m-%d') AS date, lat_index, lon_index, latitude, longitude, round(no2, 6) AS no2 FROM dense""",
    "declared_grid_sink": f"""{_declared("""SELECT event_id, date, latitude, longitude,
  no2 + CASE WHEN day(date) % 2 = 0 THEN 1 ELSE 0 END AS no2 FROM dated WHERE latitude < 30""")}
SELECT 'grid_' || strftime(date, '%Y-%m-%d') AS source_file, latitude, longitude, round(no2::float::double, 2) AS no2 FROM dense""",
    "off_grid_rows": f"""WITH {V.OBS} SELECT strftime(time::date, '%Y-%m-%d') AS date, count(*) AS n FROM obs
WHERE NOT (latitude >= 25 AND latitude < 32.5 AND longitude >= -120 AND longitude < -65) GROUP BY 1""",
    "flatten_bbox_lenient": """WITH cells AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN round(v::double, 6) END AS no2,
       25.0::double + p // 8 AS latitude, -125.0::double + p % 8 AS longitude,
       CASE WHEN vec_id % 3 <> 0 THEN strftime(DATE '2023-08-01' + vec_id::int, '%Y-%m-%d') END AS day
FROM cells WHERE p // 8 BETWEEN 1 AND 3 AND p % 8 BETWEEN 1 AND 4 AND (vec_id % 5 = 0 OR v >= -0.2::float)""",
    "flatten_grid": f"WITH {V.grid_sql()} SELECT {FLAT} FROM flat",
    "flatten_steps": f"WITH {V.grid_sql(2, 4, 8)} SELECT {FLAT} FROM flat",
    "flatten_bbox": f"WITH {V.grid_sql(2, 4, 8)} SELECT {FLAT} FROM flat WHERE {BOXED}",
    "flatten_tiles": f"WITH {V.grid_sql(2, 4, 8)} SELECT {FLAT} FROM flat WHERE {BOXED}",
    "flatten_lenient": f"""WITH {V.grid_sql()}
SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN round(v::double, 6) END AS no2,
       25.0::double + p // 8 AS latitude, -125.0::double + p % 8 AS longitude,
       CASE WHEN vec_id % 5 <> 0 THEN strftime(DATE '2023-08-01' + vec_id::int, '%Y-%m-%d') END AS day
FROM cells WHERE vec_id % 7 = 0 OR v >= -0.2::float""",
    "block_validation": """SELECT printf('granule_%05d', vec_id) AS source_file,
  CASE WHEN vec_id % 11 <> 0 AND vec_id % 7 = 0 THEN 'missing variable: no2'
       WHEN vec_id % 5 = 0 THEN 'missing variable: time' ELSE 'sizes of variables differ' END AS error
FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0""",
    "variable_aliases": f"""WITH {V.grid_sql()}
SELECT source_file, count(*) AS n, round(sum(no2), 5) AS total, min(latitude) AS lat_min, max(longitude) AS lon_max
FROM flat GROUP BY 1""",
    "dataset_structure": """WITH f AS (SELECT printf('granule_%05d', vec_id) AS source_file, label FROM embeddings)
SELECT source_file, 'dimension' AS kind, n AS name, s AS shape, NULL::varchar AS dtype, '' AS attrs
FROM f, (VALUES ('time', '2'), ('latitude', '4'), ('longitude', '8')) a(n, s)
UNION ALL
SELECT source_file, 'coordinate', n, s, t, ''
FROM f, (VALUES ('time', '2', 'timestamp_ntz'), ('latitude', '4', 'double'), ('longitude', '8', 'double')) a(n, s, t)
UNION ALL
SELECT source_file, 'variable', 'no2', '2,4,8', 'float', 'units=molecules/cm^2' FROM f
UNION ALL
SELECT source_file, 'attribute', 'label', NULL, NULL, 'value=' || label FROM f""",
    "grid_round_trip": "SELECT vec_id, true AS same, 64 AS n FROM embeddings",
    "axis_values": f"WITH {V.OBS} SELECT DISTINCT round(latitude, 6) AS latitude FROM obs",
    "grid_spine": f"""WITH {GRIDDED}
SELECT strftime(date, '%Y-%m-%d') AS date, latitude, lat_index, longitude, lon_index FROM spine""",
    "densify_grid": f"""WITH {GRIDDED}
SELECT strftime(date, '%Y-%m-%d') AS date, latitude, longitude, round(no2, 6) AS no2 FROM dense""",
    "dense_tiles": f"""WITH {GRIDDED}
SELECT 'grid_' || strftime(date, '%Y-%m-%d') AS source_file, lat_index // 2 * 2 AS lat_offset,
       latitude, longitude, round(no2::float::double, 2) AS no2 FROM dense""",
    "lineage_union": f"""WITH {V.OBS}
SELECT event_id, source_file, dense_rank() OVER (ORDER BY source_file) - 1 AS file_index,
       CASE WHEN latitude < 37 THEN round(longitude, 6) END AS longitude FROM obs""",
}
