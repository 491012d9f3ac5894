"""Registered queries: sinks read back, discovery, and the way from a manifest to rows."""

from pyspark.sql import functions as F

from nitrogrid.operators import catalog as C
from nitrogrid.operators.grid import flatten_grid, valid_blocks
from nitrogrid.plans import scoring as S
from nitrogrid.plans.catalog import manifest_observations, observations
from nitrogrid.registry import grids
from nitrogrid.registry import views as V
from nitrogrid.registry.scoring import scored_sql
from nitrogrid.schemas import GRID_BLOCK
from nitrogrid.session import work_path
from nitrogrid.sinks.grids import write_grid
from nitrogrid.sinks.replies import single_replies, write_replies
from nitrogrid.sinks.tables import preview, write_catalog_report, write_csv, write_observations
from nitrogrid.sources.files import list_files, listed
from nitrogrid.sources.granules import (
    checked_blocks, granules_by_glob, granules_by_token, read_blocks, unread_files,
)
from nitrogrid.sources.manifest import manifest_in


def _listing(spark, sf):
    key = F.col("p_partkey")
    patterns = ["TEMPO_NO2_%d.nc", "no2_tempo_%d.nc", "TEMPO_NO2_%d.NC", "TEMPO_O3_%d.nc",
                "edsc_Collection_%d.csv", "export_%d.csv"]
    name = F.coalesce(*[F.when(key % 6 == i, F.format_string(p, key)) for i, p in enumerate(patterns)])
    return V.table(spark, sf, "part").select(
        name.alias("file_name"), F.concat(F.lit("/data/"), name).alias("path")
    )


def granules_glob(spark, sf):
    return granules_by_glob(_listing(spark, sf))


def granules_token(spark, sf):
    return granules_by_token(_listing(spark, sf))


def manifest_choice(spark, sf):
    return manifest_in(_listing(spark, sf))


def observation_sink(spark, sf):
    """Observations written by day, read back and counted per day."""
    path = write_observations(V.obs(spark, sf), work_path(spark, "observations"), "time")
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("no2") / 1e13), 4).alias("total")
    )


def csv_sink(spark, sf):
    path = write_csv(V.obs(spark, sf), work_path(spark, "observations-csv"))
    schema = "event_id LONG, time TIMESTAMP_NTZ, latitude DOUBLE, longitude DOUBLE, no2 DOUBLE, source_file STRING"
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select("event_id", F.round("latitude", 6).alias("latitude"), V.scaled("no2"), "source_file")


def catalog_sink(spark, sf):
    entries = C.with_category(C.subject_entries(C.standard_columns(V.manifest(spark, sf))))
    path = write_catalog_report(
        entries, C.category_counts(entries), C.instruction_sections(entries), work_path(spark, "catalog")
    )
    schema = "row_number LONG, short_name STRING, full_row MAP<STRING, STRING>, category STRING"
    return spark.read.schema(schema).json(f"{path}/entries").select(
        "row_number", "category", "short_name", F.col("full_row")["Data Provider"].alias("data_provider")
    )


def grid_sink(spark, sf):
    """Rows made a dense grid, written as blocks, read and flattened."""
    path = write_grid(grids.gridded(spark, sf), work_path(spark, "grid"), rows_per_tile=2)
    rows = flatten_grid(valid_blocks(read_blocks(spark, path)))
    return rows.select("source_file", "latitude", "longitude", F.round("no2", 2).alias("no2"))


def unread_granules(spark, sf):
    """Blocks read from a folder that also holds three files that are not blocks, and an empty one."""
    folder = work_path(spark, "mixed")
    blocks = V.grid(spark, sf).select(*GRID_BLOCK.names)
    blocks.write.parquet(folder)
    spark.createDataFrame([], GRID_BLOCK).coalesce(1).write.mode("append").parquet(folder)
    V.table(spark, sf, "pages").select("url").repartition(3).write.mode("append").text(folder)
    found, faults = checked_blocks(spark, folder, glob="*")
    unread = faults.join(unread_files(spark, folder, "*"), ["path", "error"], "left_semi").agg(F.count(F.lit(1)))
    return found.agg(F.count(F.lit(1)).alias("blocks")).withColumn("unread", unread.scalar())


def granule_faults(spark, sf):
    """Granules of a folder with undecodable blocks and files of another format: all are accounted for.

    The folder's name has a space, an escape and a sign, and its blocks lie in folders by value
    whose names Spark escapes itself.
    """
    folder = work_path(spark, "faulty a%20b #1+") + "/50%"
    gap = F.col("vec_id") % 50 == 7
    V.grid(spark, sf).select(*[
        c if c in ("source_file", "var_attrs", "ds_attrs") else F.when(~gap, F.col(c)).alias(c) for c in GRID_BLOCK.names
    ]).withColumn("shelf", F.concat(F.lit("1:%41 "), F.length("source_file"))).write.partitionBy("shelf").parquet(folder)
    V.table(spark, sf, "pages").select("url").repartition(3).write.text(f"{folder}/shelf=other")
    rows, rejected = observations(spark, folder, "*")
    good = rows.groupBy("source_file", "file_index").agg(F.count(F.lit(1)).alias("n"))
    return good.agg(F.lit("good").alias("state"), F.count(F.lit(1)).alias("granules"), F.max("file_index").alias("last")).unionByName(
        rejected.groupBy(F.col("error").alias("state")).agg(F.count(F.lit(1)).alias("granules"), F.lit(None).cast("long").alias("last")))


def reply_sink(spark, sf):
    scored = S.score_requests(V.requests(spark, sf), S.formula_predictor(), V.AS_OF)
    path = write_replies(single_replies(scored, keep=["event_id"]), work_path(spark, "replies"))
    schema = "event_id LONG, success BOOLEAN, prediction STRUCT<air_quality: STRING>, error STRING"
    replies = spark.read.schema(schema).json(path)
    return replies.groupBy("success", "error", F.col("prediction.air_quality").alias("air_quality")).agg(
        F.count(F.lit(1)).alias("n")
    )


def preview_rows(spark, sf):
    return preview(V.obs(spark, sf), "event_id", 5).select("event_id", "source_file", V.scaled("no2"))


def _named_granules(spark, sf):
    """Block files of two kinds: canonical names, and other accepted names."""
    folder = work_path(spark, "granules %41 é+") + "/50% of #1"
    blocks = V.grid(spark, sf)
    other = F.col("vec_id") % 2 == 1
    columns = [c for c in GRID_BLOCK.names if c not in ("latitude", "longitude")]
    blocks.filter(~other).select(*GRID_BLOCK.names).repartition(2, "source_file").write.parquet(folder)
    blocks.filter(other).select(*columns, F.col("latitude").alias("lat"), F.col("longitude").alias("lon")) \
        .repartition(2, "source_file").write.mode("append").parquet(folder)
    return folder


def _observed(rows):
    return rows.select("source_file", "file_index", F.round("no2", 6).alias("no2"), "latitude", "longitude")


def manifest_to_observations(spark, sf):
    """A manifest that names files by plain paths and escaped URIs, some twice, some missing; then their rows."""
    folder = _named_granules(spark, sf)
    files = listed(spark, folder, "*.parquet")
    csv = write_csv(
        files.select(F.col("path").alias("granule"), F.lit("TEMPO").alias("what"))
        .unionAll(files.select("uri", F.lit("other NO2")))
        .unionAll(files.select(F.concat(F.lit("/gone"), "path"), F.lit("no2"))),
        work_path(spark, "collection"),
    )
    rows, _, _ = manifest_observations(spark, csv, folder)
    return _observed(rows)


def manifest_fallback(spark, sf):
    """A manifest of which no file exists: the folder's files are taken."""
    folder = _named_granules(spark, sf)
    files = list_files(spark, folder, "*.parquet")
    csv = write_csv(files.select(F.concat(F.lit("/gone"), "path").alias("granule"), F.lit("no2").alias("what")),
                    work_path(spark, "collection"))
    rows, _, _ = manifest_observations(spark, csv, folder)
    return _observed(rows)


QUERIES = {
    "granules_glob": granules_glob,
    "granules_token": granules_token,
    "manifest_choice": manifest_choice,
    "observation_sink": observation_sink,
    "csv_sink": csv_sink,
    "catalog_sink": catalog_sink,
    "grid_sink": grid_sink,
    "unread_granules": unread_granules,
    "reply_sink": reply_sink,
    "preview_rows": preview_rows,
    "manifest_to_observations": manifest_to_observations,
    "manifest_fallback": manifest_fallback,
    "granule_faults": granule_faults,
}

_LISTING = """listing AS (
  SELECT CASE p_partkey % 6 WHEN 0 THEN 'TEMPO_NO2_' || p_partkey || '.nc' WHEN 1 THEN 'no2_tempo_' || p_partkey || '.nc'
    WHEN 2 THEN 'TEMPO_NO2_' || p_partkey || '.NC' WHEN 3 THEN 'TEMPO_O3_' || p_partkey || '.nc'
    WHEN 4 THEN 'edsc_Collection_' || p_partkey || '.csv' ELSE 'export_' || p_partkey || '.csv' END AS file_name FROM part)"""


ORACLE = {
    "granules_glob": f"WITH {_LISTING} SELECT file_name, '/data/' || file_name AS path FROM listing WHERE file_name GLOB '*TEMPO*NO2*.nc'",
    "granules_token": f"""WITH {_LISTING} SELECT file_name, '/data/' || file_name AS path FROM listing
WHERE file_name LIKE '%.nc' AND upper(file_name) LIKE '%TEMPO%' AND upper(file_name) LIKE '%NO2%'""",
    "manifest_choice": f"""WITH {_LISTING} SELECT '/data/' || min(file_name) AS path FROM listing
WHERE file_name LIKE '%.csv' AND regexp_matches(lower(file_name), 'collection|edsc')""",
    "observation_sink": f"""WITH {V.OBS} SELECT strftime(time, '%Y-%m-%d') AS date, count(*) AS n,
  round(sum(no2 / 1e13), 4) AS total FROM obs GROUP BY 1""",
    "csv_sink": f"WITH {V.OBS} SELECT event_id, round(latitude, 6) AS latitude, round(no2 / 1e13, 6) AS no2, source_file FROM obs",
    "catalog_sink": f"WITH {V.MANIFEST} SELECT row_number, category, short_name, data_provider FROM subject",
    "grid_sink": f"""WITH {grids.GRIDDED}
SELECT 'grid_' || strftime(date, '%Y-%m-%d') AS source_file, latitude, longitude, round(no2::float::double, 2) AS no2 FROM dense""",
    "unread_granules": "SELECT count(*) AS blocks, 3 AS unread FROM embeddings",
    "reply_sink": f"""WITH {scored_sql('smooth')}
SELECT error IS NULL AS success, error, {V.CODE_SQL.format(x='v')} AS air_quality, count(*) AS n FROM scored GROUP BY ALL""",
    "preview_rows": f"WITH {V.OBS} SELECT event_id, source_file, round(no2 / 1e13, 6) AS no2 FROM obs ORDER BY event_id LIMIT 5",
    "granule_faults": """SELECT 'good' AS state, count(*) AS granules, max(vec_id) AS last FROM embeddings WHERE vec_id % 50 <> 7
UNION ALL SELECT 'no variables', count(*), NULL FROM embeddings WHERE vec_id % 50 = 7
UNION ALL SELECT 'unreadable file', 3, NULL""",
    **dict.fromkeys(["manifest_to_observations", "manifest_fallback"], f"""WITH {V.grid_sql()}
SELECT source_file, (SELECT count(*) FROM embeddings e WHERE e.vec_id < flat.vec_id) AS file_index,
       round(no2, 6) AS no2, latitude, longitude FROM flat"""),
}
