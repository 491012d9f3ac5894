"""Registered queries: product manifests."""

from pyspark.sql import functions as F

from nitrogrid.operators import catalog as C
from nitrogrid.registry import views as V
from nitrogrid.session import work_path
from nitrogrid.sources.manifest import (
    read_manifest, read_manifest_texts, texts_schema, with_row_number,
)
from nitrogrid.sources.records import read_split_texts

COLUMNS = ["Granule Path", "Download URL", "Acquisition Date", "Collection"]


def _entries(spark, sf):
    return C.extract_entries(V.file_manifest(spark, sf), "entry")


def _subject(spark, sf):
    return C.with_category(C.subject_entries(C.standard_columns(V.manifest(spark, sf))))


def manifest_any_keyword(spark, sf):
    return C.keyword_entries(V.file_manifest(spark, sf), columns=COLUMNS).select("entry")


def manifest_first_match(spark, sf):
    return _entries(spark, sf).select("entry", "match_column", "match_value")


def manifest_paths(spark, sf):
    return _entries(spark, sf).select("entry", "file_path", "file_url")


def manifest_attributes(spark, sf):
    return _entries(spark, sf).select("entry", F.explode("attributes").alias("key", "value"))


def manifest_row_data(spark, sf):
    return _entries(spark, sf).select("entry", F.explode("row_data").alias("key", "value"))


def resolve_files(spark, sf):
    return C.resolve_files(_entries(spark, sf), V.file_listing(spark, sf), "entry").select(
        "entry", "position", "origin", "resolved"
    )


def resolved_files(spark, sf):
    entries = C.resolve_files(_entries(spark, sf), V.file_listing(spark, sf), "entry")
    return C.resolved_files(entries)


def scan_totals(spark, sf):
    return C.scan_totals(C.standard_columns(V.manifest(spark, sf)))


def subject_entries(spark, sf):
    return C.subject_entries(C.standard_columns(V.manifest(spark, sf))).drop("full_row")


def product_categories(spark, sf):
    return _subject(spark, sf).select("row_number", "category")


def category_counts(spark, sf):
    return C.category_counts(_subject(spark, sf))


def instructions(spark, sf):
    return C.with_instructions(_subject(spark, sf)).select("row_number", "instructions")


def instruction_sections(spark, sf):
    sections = C.instruction_sections(_subject(spark, sf))
    return sections.select(
        "section", "row_number", F.length("text").alias("length"), F.md5("text").alias("md5")
    )


def csv_row_numbers(spark, sf):
    """The manifest written as sorted CSV files of 1000 keys and read with record ordinals."""
    path = work_path(spark, "manifest-csv")
    manifest = V.manifest(spark, sf).withColumn("part", F.floor(F.col("row_number") / 1000))
    columns = [c for c in manifest.columns if c != "part"]
    (
        manifest.repartition("part").sortWithinPartitions("part", "row_number")
        .write.partitionBy("part").option("header", True).csv(path)
    )
    texts = read_manifest_texts(spark, f"{path}/*/", texts_schema(columns))
    return with_row_number(texts, "record").select(
        F.col("row_number").cast("long").alias("key"), "record", F.col("Short Name").alias("short_name")
    )


def split_csv_records(spark, sf):
    """Documents, with line breaks and quotes in their cells, written as CSV and read split by split.

    Each record carries its place in its file, which its number must agree with.
    """
    path = work_path(spark, "documents-csv")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    text = F.concat(F.lit('"a", \n'), F.coalesce("text", F.lit("")), F.lit('\n\n"'))
    V.table(spark, sf, "documents").select("doc_id", text.alias("text")).repartitionByRange(4, "doc_id") \
        .sortWithinPartitions("doc_id").select("doc_id", "text", place.alias("place")) \
        .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = read_split_texts(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("sha"),
                       (F.col("row_number") == F.col("place").cast("long") + 2).alias("in_order"))


def csv_inferred(spark, sf):
    """Events written as CSV with missing-value texts, read back with inferred types."""
    path = work_path(spark, "events-csv")
    key = F.col("event_id")
    V.table(spark, sf, "events").select(
        "event_id",
        F.when(key % 7 == 0, "NA").when(key % 7 == 1, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(key % 3 == 0, "null").otherwise(F.col("event_type")).alias("event_type"),
    ).write.option("header", True).csv(path)
    rows = read_manifest(spark, path)
    kinds = dict(rows.dtypes)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("present"),
        F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last"),
    ).withColumn("types", F.lit(f"{kinds['event_id']},{kinds['value']}"))


QUERIES = {
    "manifest_any_keyword": manifest_any_keyword,
    "manifest_first_match": manifest_first_match,
    "manifest_paths": manifest_paths,
    "manifest_attributes": manifest_attributes,
    "manifest_row_data": manifest_row_data,
    "resolve_files": resolve_files,
    "resolved_files": resolved_files,
    "scan_totals": scan_totals,
    "subject_entries": subject_entries,
    "product_categories": product_categories,
    "category_counts": category_counts,
    "instructions": instructions,
    "instruction_sections": instruction_sections,
    "csv_row_numbers": csv_row_numbers,
    "csv_inferred": csv_inferred,
    "split_csv_records": split_csv_records,
}

_RESOLVED = V.FILE_MANIFEST + """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY entry) - 1 AS position,
         regexp_extract(regexp_replace(regexp_replace(file_url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1) AS url_name
  FROM entries),
listing AS (SELECT DISTINCT '/data/tempo_' || (page_id % 40) || CASE WHEN (page_id % 40) % 2 = 0 THEN '.nc' ELSE '.h5' END AS path,
    CASE WHEN (page_id % 40) % 2 = 0 THEN 'file:' ELSE 'file://' END AS scheme FROM pages),
resolved AS (
  SELECT entry, position,
         CASE WHEN path IS NOT NULL THEN 'local' WHEN file_url IS NOT NULL THEN 'download' END AS origin,
         CASE WHEN path IS NOT NULL THEN scheme || path WHEN file_url IS NULL THEN NULL
              WHEN url_name LIKE '%.nc' THEN url_name ELSE 'tempo_file_' || (position + 1) || '.nc' END AS resolved
  FROM numbered LEFT JOIN listing ON file_path = path)"""

_TEXT = """(chr(10) || 'Product: ' || short_name || chr(10) || 'Title: ' || entry_title || chr(10)
  || 'Processing Level: ' || processing_level || chr(10) || 'Version: ' || version || chr(10)
  || 'Platform: ' || platform || chr(10) || 'Start Time: ' || start_time || chr(10) || 'End Time: ' || end_time || chr(10)
  || CASE WHEN processing_level = '3' THEN chr(10) || 'Download URL Pattern:' || chr(10)
       || 'https://tempo.si.edu/data/level3/' || lower(short_name) || '/' || chr(10)
       || 'Look for files ending in .nc (NetCDF format)' || chr(10) ELSE '' END
  || repeat('-', 30))"""

_GENERAL = (
    "\nGeneral Download Instructions:\n" + "-" * 30 + "\n1. Visit: https://tempo.si.edu/\n"
    "2. Navigate to the data section\n3. Select your desired product (NO2, HCHO, O3, etc.)\n"
    "4. Choose processing level (L2 or L3)\n5. Download NetCDF (.nc) files\n"
    "6. Place downloaded files in the ''data/'' directory\n\nFor Level 3 NO2 data specifically:\n"
    "- Look for files like: TEMPO_NO2_L3_v03.nc\n- These are gridded, ready-to-use datasets\n"
    "- Perfect for analysis and visualization"
)

ORACLE = {
    "manifest_any_keyword": f"WITH {V.FILE_MANIFEST} SELECT entry FROM entries",
    "manifest_first_match": f"""WITH {V.FILE_MANIFEST}
SELECT entry, CASE WHEN m1 THEN 'Granule Path' WHEN m2 THEN 'Download URL' WHEN m3 THEN 'Acquisition Date' ELSE 'Collection' END AS match_column,
       CASE WHEN m1 THEN granule_path WHEN m2 THEN download_url WHEN m3 THEN acquisition_date ELSE collection END AS match_value
FROM entries""",
    "manifest_paths": f"WITH {V.FILE_MANIFEST} SELECT entry, file_path, file_url FROM entries",
    "manifest_attributes": f"""WITH {V.FILE_MANIFEST}
SELECT entry, 'date_Acquisition Date' AS key, acquisition_date AS value FROM entries WHERE acquisition_date IS NOT NULL
UNION ALL SELECT entry, 'product_Collection', collection FROM entries WHERE collection IS NOT NULL""",
    "manifest_row_data": f"""WITH {V.FILE_MANIFEST}
SELECT entry, 'Granule Path' AS key, granule_path AS value FROM entries
UNION ALL SELECT entry, 'Download URL', download_url FROM entries
UNION ALL SELECT entry, 'Acquisition Date', acquisition_date FROM entries
UNION ALL SELECT entry, 'Collection', collection FROM entries""",
    "resolve_files": f"WITH {_RESOLVED} SELECT entry, position, origin, resolved FROM resolved",
    "resolved_files": f"WITH {_RESOLVED} SELECT DISTINCT resolved, origin FROM resolved WHERE resolved IS NOT NULL",
    "scan_totals": f"""WITH {V.MANIFEST}
SELECT (SELECT count(*) FROM manifest) AS total_entries, (SELECT count(*) FROM subject) AS subject_entries""",
    "subject_entries": f"WITH {V.MANIFEST} SELECT * EXCLUDE (category) FROM subject",
    "product_categories": f"WITH {V.MANIFEST} SELECT row_number, category FROM subject",
    "category_counts": f"""WITH {V.MANIFEST}
SELECT category, count(*) AS entries, CASE category WHEN 'no2_products' THEN 'No2 Products'
  WHEN 'hcho_products' THEN 'Hcho Products' WHEN 'o3_products' THEN 'O3 Products'
  WHEN 'cloud_products' THEN 'Cloud Products' ELSE 'Other Products' END AS title
FROM subject GROUP BY 1""",
    "instructions": f"WITH {V.MANIFEST} SELECT row_number, {_TEXT} AS instructions FROM subject",
    "instruction_sections": f"""WITH {V.MANIFEST}, texts AS (
  SELECT 2 AS section, row_number, {_TEXT} AS text FROM subject WHERE category = 'no2_products'
  UNION ALL
  SELECT 1, 0, chr(10) || 'NO2 Products Found: ' || count(*) || chr(10) || repeat('-', 30)
  FROM subject WHERE category = 'no2_products' HAVING count(*) > 0
  UNION ALL SELECT 0, 0, 'TEMPO Data Download Instructions:' || chr(10) || repeat('=', 50)
  UNION ALL SELECT 3, 0, '{_GENERAL}')
SELECT section, row_number, length(text) AS length, md5(text) AS md5 FROM texts""",
    "csv_row_numbers": f"""WITH {V.MANIFEST}
SELECT row_number AS key, short_name,
       row_number() OVER (PARTITION BY row_number // 1000 ORDER BY row_number) + 1 AS record FROM manifest""",
    "split_csv_records": """SELECT doc_id, true AS in_order,
  sha256('"a", ' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '"') AS sha FROM documents""",
    "csv_inferred": """SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, count(*) AS n,
  count(*) FILTER (event_id % 7 > 1) AS present, round(sum(value) FILTER (event_id % 7 > 1), 4) AS total,
  max(event_id) AS last, 'bigint,double' AS types
FROM events GROUP BY 1""",
}
