"""Relations the registered queries run on, derived from the given tables.

Each relation exists twice: as a DataFrame function and as SQL text for the oracle.
"""

from pyspark.sql import functions as F

from nitrogrid.functions.calendar import is_weekend


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- observations -----------------------------------------------------------------------

def obs(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("time"),
        (F.lit(25.0) + F.pmod("user_id", F.lit(251)) * F.lit(0.1)).alias("latitude"),
        (F.lit(-125.0) + F.pmod(F.col("event_id") * 7, F.lit(601)) * F.lit(0.1)).alias("longitude"),
        (F.col("value") * F.lit(1e13)).alias("no2"),
        F.col("event_type").alias("source_file"),
    )


OBS = """obs AS (
  SELECT event_id, ts AS time,
         25.0::double + (user_id % 251) * 0.1::double AS latitude,
         -125.0::double + ((event_id * 7) % 601) * 0.1::double AS longitude,
         value * 1e13::double AS no2, event_type AS source_file
  FROM events)"""


def obs_missing(spark, sf):
    """Null values at every 17th event, NaN at every 23rd."""
    key = F.col("event_id")
    return obs(spark, sf).withColumn(
        "no2",
        F.when(key % 17 == 0, F.lit(None)).when(key % 23 == 0, F.lit(float("nan")))
        .otherwise(F.col("no2")),
    )


OBS_MISSING = OBS + """, obs_missing AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 = 0 OR event_id % 23 = 0 THEN NULL ELSE no2 END AS no2)
  FROM obs)"""


def obs_year(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("time"),
        (F.lit(25.0) + F.pmod("o_custkey", F.lit(251)) * F.lit(0.1)).alias("latitude"),
        (F.lit(-125.0) + F.pmod(F.col("o_orderkey") * 7, F.lit(601)) * F.lit(0.1)).alias("longitude"),
        (F.col("o_totalprice") * F.lit(5e9)).alias("no2"),
        F.col("o_orderpriority").alias("source_file"),
    )


OBS_YEAR = """obs_year AS (
  SELECT o_orderkey AS event_id, o_orderdate AS time,
         25.0::double + (o_custkey % 251) * 0.1::double AS latitude,
         -125.0::double + ((o_orderkey * 7) % 601) * 0.1::double AS longitude,
         o_totalprice * 5e9::double AS no2, o_orderpriority AS source_file
  FROM orders)"""

# --- grid blocks: 64 values read as time x latitude x longitude -----------------------------

AXIS = "transform(sequence(0, {n} - 1), i -> {origin}D + i)"


def grid(spark, sf, steps=1, lats=8, lons=8):
    """Blocks of steps x lats x lons; strongly negative values are gaps."""
    start = F.to_timestamp_ntz(F.lit("2023-08-01 00:00:00"))
    days = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.timestamp_add("DAY", F.col("vec_id") + i, start),
    )
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.format_string("granule_%05d", "vec_id").alias("source_file"),
        days.alias("time"),
        F.expr(AXIS.format(n=lats, origin="25.0")).alias("latitude"),
        F.expr(AXIS.format(n=lons, origin="-125.0")).alias("longitude"),
        F.transform("embedding", lambda x: F.when(x >= -0.2, x)).alias("no2"),
        F.create_map(F.lit("units"), F.lit("molecules/cm^2")).alias("var_attrs"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("ds_attrs"),
    )


def grid_sql(steps=1, lats=8, lons=8):
    """Flattened grid rows, gaps removed."""
    return f"""cells AS (
  SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings),
flat AS (
  SELECT vec_id, printf('granule_%05d', vec_id) AS source_file, p, v::double AS no2,
         25.0::double + (p // {lons}) % {lats} AS latitude,
         -125.0::double + p % {lons} AS longitude,
         DATE '2023-08-01' + (vec_id + p // {lats * lons})::int AS day
  FROM cells WHERE v >= -0.2::float)"""


# --- product manifest -------------------------------------------------------------------------

def manifest(spark, sf):
    """A manifest with standard headers (``End Time`` is absent) plus ``row_number``."""
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    short = (
        F.when(key % 6 == 0, "TEMPO_NO2_L3").when(key % 6 == 1, "TEMPO_HCHO_L2")
        .when(key % 6 == 2, "TEMPO_O3TOT_L3").when(key % 6 == 3, "TEMPO_CLDO4_L2")
        .when(key % 6 == 4, "TEMPO_RADT_L1").otherwise(F.concat(F.lit("OMI_"), "p_type"))
    )
    title = (
        F.when(key % 10 == 0, F.concat(F.lit("Tempo "), name))
        .when(key % 15 == 1, F.concat(name, F.lit(" formaldehyde")))
        .when(key % 15 == 2, F.concat(F.lit("Ozone "), name))
        .when(key % 15 == 3, F.concat(name, F.lit(" cloud")))
        .when(key % 15 == 4, F.concat(name, F.lit(" NO2 and O3")))
        .otherwise(name)
    )
    return table(spark, sf, "part").select(
        key.alias("row_number"),
        F.col("p_brand").alias("Data Provider"),
        short.alias("Short Name"),
        F.concat(F.lit("V"), (size % 4).cast("string")).alias("Version"),
        title.alias("Entry Title"),
        (size % 3 + 1).cast("string").alias("Processing Level"),
        F.when(key % 7 != 0, F.col("p_type")).alias("Platform"),
        F.when(key % 5 != 0, F.concat(F.lit("2023-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")))
        .alias("Start Time"),
    )


MANIFEST = """manifest AS (
  SELECT p_partkey AS row_number, p_brand AS data_provider,
         CASE p_partkey % 6 WHEN 0 THEN 'TEMPO_NO2_L3' WHEN 1 THEN 'TEMPO_HCHO_L2'
              WHEN 2 THEN 'TEMPO_O3TOT_L3' WHEN 3 THEN 'TEMPO_CLDO4_L2'
              WHEN 4 THEN 'TEMPO_RADT_L1' ELSE 'OMI_' || p_type END AS short_name,
         'V' || (p_size % 4) AS version,
         CASE WHEN p_partkey % 10 = 0 THEN 'Tempo ' || p_name
              WHEN p_partkey % 15 = 1 THEN p_name || ' formaldehyde'
              WHEN p_partkey % 15 = 2 THEN 'Ozone ' || p_name
              WHEN p_partkey % 15 = 3 THEN p_name || ' cloud'
              WHEN p_partkey % 15 = 4 THEN p_name || ' NO2 and O3'
              ELSE p_name END AS entry_title,
         (p_size % 3 + 1)::varchar AS processing_level,
         CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS platform,
         CASE WHEN p_partkey % 5 <> 0 THEN '2023-01-' || lpad((p_size % 28 + 1)::varchar, 2, '0') END AS start_time,
         '' AS end_time
  FROM part),
subject AS (
  SELECT row_number, data_provider, short_name, version, entry_title, processing_level,
         coalesce(platform, '') AS platform, coalesce(start_time, '') AS start_time, end_time,
         CASE WHEN upper(short_name) LIKE '%NO2%' OR upper(entry_title) LIKE '%NO2%' THEN 'no2_products'
              WHEN upper(short_name) LIKE '%HCHO%' OR upper(entry_title) LIKE '%HCHO%'
                   OR upper(entry_title) LIKE '%FORMALDEHYDE%' THEN 'hcho_products'
              WHEN upper(short_name) LIKE '%O3%' OR upper(entry_title) LIKE '%O3%'
                   OR upper(entry_title) LIKE '%OZONE%' THEN 'o3_products'
              WHEN upper(short_name) LIKE '%CLD%' OR upper(entry_title) LIKE '%CLOUD%' THEN 'cloud_products'
              ELSE 'other_products' END AS category
  FROM manifest
  WHERE upper(short_name) LIKE '%TEMPO%' OR upper(entry_title) LIKE '%TEMPO%')"""


def file_manifest(spark, sf):
    """A manifest of unknown shape, from page URLs."""
    key = F.col("page_id")
    return table(spark, sf, "pages").select(
        key.alias("entry"),
        F.when(key % 3 == 0, F.format_string(" /data/tempo_%d.nc ", key % 40)).when(key % 3 == 1, "  ")
        .alias("Granule Path"),
        F.when(key % 4 == 0, F.format_string("https://host.example/a/no2_%d.nc?token=x", key % 50))
        .when(key % 4 != 3, F.col("url")).alias("Download URL"),
        F.when(key % 5 != 0, F.concat(F.lit("2023-08-"), F.lpad((key % 30 + 1).cast("string"), 2, "0")))
        .alias("Acquisition Date"),
        F.when(key % 2 == 0, "Nitrogen Dioxide column").otherwise("radiance").alias("Collection"),
    )


FILE_MANIFEST = """file_manifest AS (
  SELECT page_id AS entry,
         CASE WHEN page_id % 3 = 0 THEN ' /data/tempo_' || (page_id % 40) || '.nc '
              WHEN page_id % 3 = 1 THEN '  ' END AS granule_path,
         CASE WHEN page_id % 4 = 0 THEN 'https://host.example/a/no2_' || (page_id % 50) || '.nc?token=x'
              WHEN page_id % 4 <> 3 THEN url END AS download_url,
         CASE WHEN page_id % 5 <> 0 THEN '2023-08-' || lpad((page_id % 30 + 1)::varchar, 2, '0') END AS acquisition_date,
         CASE WHEN page_id % 2 = 0 THEN 'Nitrogen Dioxide column' ELSE 'radiance' END AS collection
  FROM pages),
matched AS (
  SELECT *, coalesce(nullif(trim(granule_path), ''), nullif(trim(download_url), '')) AS file_path, nullif(trim(download_url), '') AS file_url,
         coalesce(regexp_matches(lower(granule_path), 'tempo|no2|nitrogen dioxide'), false) AS m1,
         coalesce(regexp_matches(lower(download_url), 'tempo|no2|nitrogen dioxide'), false) AS m2,
         coalesce(regexp_matches(lower(acquisition_date), 'tempo|no2|nitrogen dioxide'), false) AS m3,
         coalesce(regexp_matches(lower(collection), 'tempo|no2|nitrogen dioxide'), false) AS m4
  FROM file_manifest),
entries AS (SELECT * FROM matched WHERE m1 OR m2 OR m3 OR m4)"""


def file_listing(spark, sf):
    """Files that exist, one row each, as URIs: of the odd numbers the name has another ending."""
    key = F.col("page_id") % 40
    name = F.when(key % 2 == 0, "file:/data/tempo_%d.nc").otherwise("file:///data/tempo_%d.h5")
    return table(spark, sf, "pages").select(
        F.replace(name, F.lit("%d"), key.cast("string")).alias("path")
    ).distinct()


# --- scoring requests ---------------------------------------------------------------------------

AS_OF = "2024-01-20 10:00:00"


def requests(spark, sf):
    key, value = F.col("event_id"), F.col("value")
    events = table(spark, sf, "events")
    lat = F.lit(25.0) + F.pmod("user_id", F.lit(251)) * F.lit(0.1)
    lon = F.lit(-125.0) + F.pmod(key * 7, F.lit(601)) * F.lit(0.1)
    given = key % 5 != 0
    return events.select(
        "event_id",
        F.when(key % 13 == 0, None).when(key % 11 == 0, lat + 40).otherwise(lat).alias("latitude"),
        F.when(key % 17 == 0, lon + 70).otherwise(lon).alias("longitude"),
        F.when(key % 4 != 0, F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("name"),
        F.when(given, F.month("ts")).alias("month"),
        F.when(given, F.dayofyear("ts")).alias("day_of_year"),
        F.when(given, is_weekend(F.col("ts"))).alias("is_weekend"),
        F.when(given, value % 40).alias("temperature"),
        F.when(given, value / 30).alias("wind_speed"),
        F.when(given, (F.lit(20) + F.col("user_id") % 60).cast("double")).alias("humidity"),
    )


REQUESTS = """requests AS (
  SELECT event_id,
         CASE WHEN event_id % 13 = 0 THEN NULL
              WHEN event_id % 11 = 0 THEN 25.0::double + (user_id % 251) * 0.1::double + 40
              ELSE 25.0::double + (user_id % 251) * 0.1::double END AS latitude,
         CASE WHEN event_id % 17 = 0 THEN -125.0::double + ((event_id * 7) % 601) * 0.1::double + 70
              ELSE -125.0::double + ((event_id * 7) % 601) * 0.1::double END AS longitude,
         CASE WHEN event_id % 4 <> 0 THEN 'user ' || user_id END AS name,
         CASE WHEN event_id % 5 <> 0 THEN month(ts) END AS month,
         CASE WHEN event_id % 5 <> 0 THEN dayofyear(ts) END AS day_of_year,
         CASE WHEN event_id % 5 <> 0 THEN (isodow(ts) >= 6)::int END AS is_weekend,
         CASE WHEN event_id % 5 <> 0 THEN value % 40 END AS temperature,
         CASE WHEN event_id % 5 <> 0 THEN value / 30 END AS wind_speed,
         CASE WHEN event_id % 5 <> 0 THEN (20 + user_id % 60)::double END AS humidity
  FROM events)"""


def batch_requests(spark, sf):
    """Requests of 16 consecutive events; covariates depend on the request."""
    request = F.floor(F.col("event_id") / 16)
    rows = requests(spark, sf).withColumn("request_id", request)
    listed = F.array_sort(F.collect_list(F.struct("event_id", "latitude", "longitude", "name")))
    grouped = rows.groupBy("request_id").agg(listed.alias("l"))
    given = F.col("request_id") % 3 != 0
    return grouped.select(
        "request_id",
        F.transform("l", lambda e: F.struct(
            e["latitude"].alias("latitude"), e["longitude"].alias("longitude"), e["name"].alias("name"),
        )).alias("locations"),
        F.when(given, (F.col("request_id") % 12 + 1).cast("int")).alias("month"),
        F.when(given, (F.col("request_id") % 365 + 1).cast("int")).alias("day_of_year"),
        F.when(given, (F.col("request_id") % 2).cast("int")).alias("is_weekend"),
        F.lit(None).cast("double").alias("temperature"),
        F.lit(None).cast("double").alias("wind_speed"),
        F.lit(None).cast("double").alias("humidity"),
    )


SMOOTH_SQL = """1e15::double + 0.5e15::double * exp(-(pow({lat} - 40.0::double, 2) + pow({lon} + 100.0::double, 2)) / 100.0::double)
  + 0.3e15::double * sin(2 * pi() * {doy} / 365) + 0.2e15::double * (1 - {weekend})"""

BOXES_SQL = """greatest(1e15::double
  + (CASE WHEN {lat} BETWEEN 40 AND 41 AND {lon} BETWEEN -75 AND -73 THEN 2.0::double
          WHEN {lat} BETWEEN 33 AND 35 AND {lon} BETWEEN -119 AND -117 THEN 1.8::double
          WHEN {lat} BETWEEN 41 AND 42 AND {lon} BETWEEN -88 AND -87 THEN 1.6::double ELSE 0 END) * 0.5e15::double
  + (1.0::double + 0.4::double * sin(2 * pi() * {doy} / 365)) * 0.3e15::double
  + (CASE WHEN {weekend} = 1 THEN 0.7::double ELSE 1.0::double END) * 0.2e15::double
  + (1.0::double + 0.2::double * ({t} / 40.0::double) - 0.1::double * ({w} / 30.0::double)) * 0.1e15::double, 1e14::double)"""

CODE_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 2e15 THEN 'HIGH_POLLUTION' WHEN {x} > 1.5e15 THEN 'MODERATE_POLLUTION'
  WHEN {x} > 1e15 THEN 'LOW_POLLUTION' ELSE 'CLEAN_AIR' END"""
COLOUR_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 2e15 THEN '#FF4444' WHEN {x} > 1.5e15 THEN '#FFAA00'
  WHEN {x} > 1e15 THEN '#44AA44' ELSE '#00AA00' END"""


def scaled(column, alias=None, unit=1e13, digits=6):
    """A concentration in readable units, rounded for comparison."""
    name = column if isinstance(column, str) else None
    c = F.col(column) if name else column
    return F.round(c / F.lit(unit), digits).alias(alias or name)
