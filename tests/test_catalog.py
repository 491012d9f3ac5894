import os

import pytest

from nitrogrid import constants as K
from nitrogrid.operators import catalog as C
from nitrogrid.operators.ordinals import with_ordinal
from nitrogrid.plans.catalog import catalog_report, manifest_files, manifest_observations, observations
from nitrogrid.schemas import GRID_BLOCK, OBSERVATION
from nitrogrid.sources.files import list_files
from nitrogrid.sources.granules import decode_granules, find_granules, find_granules_by_token, unread_files
from nitrogrid.sources.manifest import (
    find_manifest, infer_types, read_manifest, read_manifest_texts, with_row_number,
)
from tests.test_grid import block, blocks

HEADERS = list(K.MANIFEST_COLUMNS.values())


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def entries(spark, *rows):
    return spark.createDataFrame(
        [(i + 2, "P", name, "1", title, level, "GEO", "2023", "") for i, (name, title, level) in enumerate(rows)],
        "row_number long, data_provider string, short_name string, version string, entry_title string, "
        "processing_level string, platform string, start_time string, end_time string",
    )


def test_first_rule_wins(spark):
    rows = [
        ("TEMPO_NO2_O3", "x", "3"), ("A", "Tempo formaldehyde ozone", "2"), ("TEMPO_O3", "cloud", "2"),
        ("TEMPO_CLDO4", "x", "2"), ("TEMPO_X", "total cloud", "2"), ("TEMPO_CLOUD", "x", "2"),
        ("TEMPO_OZONE", "x", "2"), ("TEMPO_FORMALDEHYDE", "x", "2"), ("tempo_no2", "x", "2"),
    ]
    found = C.with_category(entries(spark, *rows)).orderBy("row_number").select("category").collect()
    assert [r[0] for r in found] == [
        "no2_products", "hcho_products", "o3_products", "cloud_products", "cloud_products",
        "other_products", "other_products", "other_products", "no2_products",
    ]


def test_counts_leave_out_empty_categories(spark):
    counts = C.category_counts(C.with_category(entries(spark, ("TEMPO_NO2", "", "3"), ("TEMPO_NO2", "", "2"))))
    assert [tuple(r) for r in counts.select("category", "entries", "title").collect()] == [
        ("no2_products", 2, "No2 Products")
    ]


def test_keyword_never_spans_two_cells(spark):
    df = spark.createDataFrame(
        [(0, "tem", "po"), (1, None, "a TEMPO b"), (2, "Nitrogen Dioxide", "no2"), (3, "nitrogen", "dioxide")],
        "id int, a string, b string",
    )
    assert sorted(r.id for r in C.keyword_entries(df, columns=["a", "b"]).collect()) == [1, 2]
    first = {r.id: (r.match_column, r.match_value) for r in C.with_first_match(df, columns=["a", "b"]).collect()}
    assert first == {0: (None, None), 1: ("b", "a TEMPO b"), 2: ("a", "Nitrogen Dioxide"), 3: (None, None)}


def test_loose_column_roles():
    roles = C.column_roles(["Vendor", "Granule Path", "download_url", "Sentiment", "ShortName", "no2 mean"])
    assert roles == {
        "file_path": ["Granule Path", "download_url"], "url": ["download_url"],
        "date": ["Vendor", "Sentiment"], "product": ["ShortName"], "subject": ["no2 mean"],
    }


def test_subject_columns_are_rows(spark):
    df = spark.createDataFrame([(1, 2)], "`TEMPO id` int, other int")
    assert [r.column for r in C.subject_columns(df).collect()] == ["TEMPO id"]
    assert C.subject_columns(df.select("other")).count() == 0


def test_entries_without_any_role(spark):
    df = spark.createDataFrame([(5, "tempo"), (6, "x")], "key int, a string")
    rows = C.extract_entries(df, "key").collect()
    assert [(r.key, r.file_path, r.file_url, r.attributes, r.row_data) for r in rows] == [
        (5, None, None, {}, {"a": "tempo"})
    ]


def test_resolution_prefers_existing_files_and_numbers_the_rest(spark):
    df = spark.createDataFrame(
        [(10, "tempo", " /d/a.nc ", "https://h/x.nc"), (11, "none", None, None),
         (12, "tempo", "/d/gone.nc", "https://h/x.nc?q"), (13, "tempo", "/d/a.nc", None),
         (14, "tempo", None, "https://h/dir/"), (15, "tempo", None, None)],
        "key int, what string, file string, link string",
    )
    listing = spark.createDataFrame([("/d/a.nc",)], "path string")
    found = C.resolve_files(C.extract_entries(df, "key"), listing, "key").orderBy("key").collect()
    assert [(r.key, r.position, r.origin, r.resolved) for r in found] == [
        (10, 0, "local", "/d/a.nc"), (12, 1, "download", "x.nc"), (13, 2, "local", "/d/a.nc"),
        (14, 3, "download", "tempo_file_4.nc"), (15, 4, None, None),
    ]
    files = C.resolved_files(C.resolve_files(C.extract_entries(df, "key"), listing, "key"))
    assert sorted(r.resolved for r in files.collect()) == ["/d/a.nc", "tempo_file_4.nc", "x.nc"]


def test_ordinals_across_ranges(spark):
    keys = [3, 5, 1_000, 17, 4_000_000, 2_500, 18]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    found = {r.k: r.n for r in with_ordinal(df, "k", "n", start=1).collect()}
    assert found == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_csv_records_are_numbered_not_lines(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'Short Name,Entry Title\nA,"two\nlines"\nB,"say ""hi"""\nC\n')
    rows = with_row_number(read_manifest_texts(spark, path)).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [("A", "two\nlines", 2), ("B", 'say "hi"', 3), ("C", None, 4)]


def test_row_numbers_over_file_splits(spark, tmp_path):
    path = write(tmp_path / "big.csv", "k\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        texts = spark.read.option("header", True).csv(path)
        assert texts.rdd.getNumPartitions() > 3
        rows = with_row_number(texts).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(int(r.k) + 2 == r.row_number for r in rows) and len(rows) == 5000


def test_row_numbers_through_several_files(spark, tmp_path):
    for part in range(3):
        write(tmp_path / "m" / f"part{part}.csv", "k\n" + "".join(f"{part}{i}\n" for i in range(4)))
    texts = read_manifest_texts(spark, str(tmp_path / "m"))
    rows = sorted((r.n, r.k) for r in with_row_number(texts, "n", 0, per_file=False).collect())
    assert rows == [(i, f"{i // 4}{i % 4}") for i in range(12)]
    assert sorted(r.n for r in with_row_number(texts, "n").collect()) == sorted([2, 3, 4, 5] * 3)


def test_short_records_and_absent_columns(spark, tmp_path):
    path = write(tmp_path / "m.csv", "Short Name,Entry Title,Version\nTEMPO_NO2_L3\nOTHER,Tempo thing,2\nX,y,1\n")
    standard = C.standard_columns(with_row_number(read_manifest_texts(spark, path)))
    rows = C.subject_entries(standard).orderBy("row_number").collect()
    assert [(r.row_number, r.short_name, r.entry_title, r.version, r.end_time) for r in rows] == [
        (2, "TEMPO_NO2_L3", "", "", ""), (3, "OTHER", "Tempo thing", "2", ""),
    ]
    assert rows[0].full_row == {"Short Name": "TEMPO_NO2_L3", "Entry Title": None, "Version": None}
    assert tuple(C.scan_totals(standard).first()) == (3, 2)


def test_missing_texts_and_types(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,b,c,d,e\n1,NA,x,True,\n2,2.5,n/a,False,\nnull,-1e3,Na,,NaN\n")
    df = read_manifest(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    assert sorted(map(tuple, df.collect()), key=str) == sorted([
        (1, None, "x", True, None), (2, 2.5, None, False, None), (None, -1000.0, "Na", None, None),
    ], key=str)
    assert infer_types(spark.createDataFrame([("99999999999999999999",)], "x string")) == {"x": "double"}


def test_discovery(spark, tmp_path):
    for name in ("b_EDSC_export.csv", "a_Collection.csv", "a_other.csv", "collection.txt"):
        write(tmp_path / "c" / name, "x\n1\n")
    assert os.path.basename(find_manifest(spark, str(tmp_path / "c")).first().path) == "a_Collection.csv"
    names = ["TEMPO_NO2_1.nc", "NO2_x_tempo.nc", "TEMPO_O3.nc", "TEMPO_NO2.NC", "tempo_no2.nc"]
    for name in names:
        write(tmp_path / "g" / name, "x")
    folder = str(tmp_path / "g")
    assert [r.file_name for r in find_granules(spark, folder).collect()] == ["TEMPO_NO2_1.nc"]
    assert sorted(r.file_name for r in find_granules_by_token(spark, folder).collect()) == [
        "NO2_x_tempo.nc", "TEMPO_NO2_1.nc", "tempo_no2.nc"
    ]
    assert find_granules(spark, folder, "*O3*.nc").count() == 1
    assert find_manifest(spark, folder).count() == 0


def test_instruction_document(spark):
    df = C.with_category(entries(spark, ("TEMPO_NO2_L3", "Title A", "3"), ("TEMPO_O3", "t", "3"), ("TEMPO_NO2_L2", "B", "2")))
    parts = C.instruction_sections(df).orderBy("section", "row_number").collect()
    document = "\n".join(r.text for r in parts)
    rule = "-" * 30
    assert document.startswith(
        "TEMPO Data Download Instructions:\n" + "=" * 50 + "\n\nNO2 Products Found: 2\n" + rule
        + "\n\nProduct: TEMPO_NO2_L3\nTitle: Title A\nProcessing Level: 3\nVersion: 1\nPlatform: GEO\n"
        "Start Time: 2023\nEnd Time: \n\nDownload URL Pattern:\nhttps://tempo.si.edu/data/level3/tempo_no2_l3/\n"
        "Look for files ending in .nc (NetCDF format)\n" + rule + "\n\nProduct: TEMPO_NO2_L2\n"
    )
    assert document.endswith("- Perfect for analysis and visualization")
    assert "TEMPO_O3" not in document


def test_no_products_no_header(spark):
    parts = C.instruction_sections(C.with_category(entries(spark, ("TEMPO_O3", "t", "3")))).collect()
    assert sorted(r.section for r in parts) == [0, 3]


def test_catalog_report_is_written(spark, tmp_path):
    path = write(tmp_path / "m.csv", ",".join(HEADERS) + "\n" + "\n".join(
        f"P,TEMPO_{name},1,title,3,GEO,2023,2024" for name in ("NO2", "NO2", "O3", "X")) + "\nP,OTHER,1,t,3,G,1,2\n")
    out = str(tmp_path / "out")
    _, counts, _ = catalog_report(spark, path, out)
    assert {r.category: r.entries for r in counts.collect()} == {
        "no2_products": 2, "o3_products": 1, "other_products": 1}
    again = spark.read.json(f"{out}/entries")
    assert again.filter("category = 'no2_products'").count() == 2
    assert spark.read.json(f"{out}/instructions").count() == 2 + 1 + 2


def test_manifest_to_observations(spark, tmp_path):
    data = tmp_path / "data"
    for name, values in (("g1", None), ("g2", [1.0])):
        blocks(spark, block(name, no2=values)).coalesce(1).write.parquet(str(data / f"TEMPO_NO2_{name}.nc"))
    listed = [r.path for r in list_files(spark, str(data / "*"), "*.parquet").collect()]
    path = write(tmp_path / "collection.csv", "granule,what\n" + "\n".join(f"{p},tempo" for p in listed * 2) + "\n/gone.nc,no2\n")
    files = manifest_files(spark, path, str(data / "*"))
    found = [r.resolved for r in files.collect()]
    assert sorted(found) == sorted(listed)
    rows, rejected = observations(spark, str(data / "*"))
    assert rows.count() == 6 and rows.columns == OBSERVATION.names and {r.file_index for r in rows.collect()} == {0}
    assert [tuple(r) for r in rejected.collect()] == [("g2", "sizes of variables differ")]
    named, _, absent = manifest_observations(spark, path, str(data / "*"))
    assert named.count() == 6 and absent.count() == 0
    other = write(tmp_path / "other.csv", "granule,link,what\n/gone.nc,https://h/tempo.nc,no2\n")
    fallback, _, absent = manifest_observations(spark, other, str(data / "*"))
    assert fallback.count() == 6 and [tuple(r) for r in absent.collect()] == [("tempo.nc", "download")]


def test_decoding_stage_isolates_bad_files(spark, tmp_path):
    import json
    from datetime import datetime

    def decoder(name, content):
        values = json.loads(content)
        return {"time": [datetime(2023, 8, 1)], "latitude": [25.0], "longitude": [-125.0, -124.0],
                "no2": values, "var_attrs": {}, "ds_attrs": {"name": name}}

    write(tmp_path / "TEMPO_NO2_a.nc", "[1.5, 2.5]")
    write(tmp_path / "TEMPO_NO2_b.nc", "not json")
    decoded = decode_granules(spark, str(tmp_path), decoder)
    from nitrogrid.operators.grid import flatten_grid, rejected_blocks, validate_blocks

    assert sorted(r.no2 for r in flatten_grid(decoded).collect()) == [1.5, 2.5]
    bad = rejected_blocks(validate_blocks(decoded)).collect()
    assert [tuple(r) for r in bad] == [("TEMPO_NO2_b.nc", "JSONDecodeError: Expecting value: line 1 column 1 (char 0)")]


def test_corrupt_files_are_reported(spark, tmp_path):
    folder = tmp_path / "blocks"
    blocks(spark, block("ok")).coalesce(1).write.parquet(str(folder))
    write(folder / "broken.parquet", "this is not parquet")
    assert [r.file_name for r in unread_files(spark, str(folder)).collect()] == ["broken.parquet"]


def test_damaged_files_are_rejected_whole(spark, tmp_path):
    """Sound, half-damaged, foreign and empty files: good and rejected ones make up the folder."""
    folder = tmp_path / "blocks"
    blocks(spark, block("ok")).coalesce(1).write.parquet(str(folder))
    spark.createDataFrame([], GRID_BLOCK).coalesce(1).write.mode("append").parquet(str(folder))
    many = spark.range(60_000).selectExpr("format_string('g%06d', id) as source_file", "array(timestamp_ntz'2023-08-01') as time",
                                          "array(25D) as latitude", "array(-125D) as longitude", "array(float(rand(1))) as no2",
                                          "cast(null as map<string,string>) as var_attrs", "cast(null as map<string,string>) as ds_attrs")
    half = tmp_path / "half"
    many.coalesce(1).write.option("parquet.page.size", "4096").parquet(str(half))
    source = next(half.glob("part-*.parquet"))
    content = bytearray(source.read_bytes())
    for at in range(len(content) * 2 // 3, len(content) * 2 // 3 + 3000):
        content[at] ^= 0x5A
    (folder / "half.parquet").write_bytes(bytes(content))
    write(folder / "broken.parquet", "this is not parquet")
    faults = {r.file_name: r.error for r in unread_files(spark, str(folder)).collect()}
    assert set(faults) == {"half.parquet", "broken.parquet"}
    rows, rejected = observations(spark, str(folder))
    found = rows.collect()
    assert {r.source_file for r in found} == {"ok"} and len(found) == 6
    assert {r.source_file for r in rejected.collect()} == {"half.parquet", "broken.parquet"}
    assert {r.file_index for r in found} == {2}


def test_ordinals_keep_null_keys(spark):
    df = spark.createDataFrame([(None, "x"), (5, "y"), (-3, "z")], "k long, v string")
    assert sorted((r.n, r.v) for r in with_ordinal(df, "k", "n").collect()) == [(0, "x"), (1, "z"), (2, "y")]


def test_ordinals_of_tasks_that_write_several_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        df = spark.range(200).selectExpr("(id * 37) % 200 as k").repartition(5)
        assert sorted((r.n, r.k) for r in with_ordinal(df, "k", "n").collect()) == [(i, i) for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


NAMES = ["plain", "with space", "per%20cent", "100%", "a#b", "a+b", "a=b", "day=2023-08-01/a", "t=12%3A30/b", "é/ü c"]


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Sound files under names with characters that addresses escape, and one damaged file beside each."""
    folder = tmp_path / "odd %41 folder"

    for name in NAMES:
        at = tmp_path / "made"
        blocks(spark, block(name)).coalesce(1).write.mode("overwrite").parquet(str(at))
        target = folder / f"{name}.parquet" if "/" not in name else folder / "sub" / f"{name.replace('/', '_')}.parquet"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(next(at.glob("part-*.parquet")).read_bytes())
    return folder


def test_names_with_escapes_are_sound(spark, odd_folder):
    for sub, n in ((odd_folder, 7), (odd_folder / "sub", 3)):
        rows, rejected = observations(spark, str(sub))
        assert rejected.count() == 0
        assert rows.select("source_file").distinct().count() == n
        assert unread_files(spark, str(sub)).count() == 0


def test_damaged_file_with_escapes_does_not_end_the_scan(spark, odd_folder):
    write(odd_folder / "bad %41 #.parquet", "no parquet")
    rows, rejected = observations(spark, str(odd_folder))
    assert [(r.source_file, r.error) for r in rejected.collect()] == [("bad %41 #.parquet", "unreadable file")]
    assert rows.select("source_file").distinct().count() == 7


def test_wanted_files_with_escapes(spark, odd_folder):
    wanted = spark.createDataFrame([(f"{odd_folder}/with space.parquet",), (f"file:{odd_folder}/a#b.parquet",)], "path string")
    rows, rejected = observations(spark, str(odd_folder), wanted=wanted)
    assert {r.source_file for r in rows.collect()} == {"with space", "a#b"} and rejected.count() == 0


def test_partition_folders(spark, tmp_path):
    folder = str(tmp_path / "parts")
    made = blocks(spark, block("x")).selectExpr("*", "'12:30 %20' as day")
    made.write.partitionBy("day").parquet(folder)
    write(tmp_path / "parts" / "day=2" / "bad.parquet", "no parquet")
    rows, rejected = observations(spark, folder)
    assert rows.count() == 6 and [r.source_file for r in rejected.collect()] == ["bad.parquet"]


def test_large_file_without_rows_is_sound(spark, tmp_path, monkeypatch):
    from nitrogrid.sources import granules

    folder = tmp_path / "blocks"
    blocks(spark, block("ok")).coalesce(1).write.parquet(str(folder))
    spark.createDataFrame([], GRID_BLOCK).coalesce(1).write.mode("append").parquet(str(folder))
    write(folder / "bad.parquet", "no parquet, but long enough")
    for limit in (granules.SMALL, 0):
        monkeypatch.setattr(granules, "SMALL", limit)
        assert [r.file_name for r in unread_files(spark, str(folder)).collect()] == ["bad.parquet"]


@pytest.mark.parametrize("entry, found", [
    ("/d/a b.parquet", "/d/a b.parquet"), ("file:/d/a b.parquet", "/d/a b.parquet"), ("file:///d/a%20b.parquet", "/d/a b.parquet"),
    ("/d/a%20b.parquet", "/d/a b.parquet"), ("/d//a b.parquet", "/d/a b.parquet"), ("/d/x%20y.parquet", "/d/x%20y.parquet"),
    ("/d/a+b.parquet", "/d/a+b.parquet"), ("/d/100%.parquet", "/d/100%.parquet"), ("hdfs://nn/d/a b.parquet", None),
])
def test_entries_find_local_files(spark, entry, found):
    from nitrogrid.operators.catalog import resolve_files

    listing = spark.createDataFrame([("/d/a b.parquet",), ("/d/x%20y.parquet",), ("/d/a+b.parquet",), ("/d/100%.parquet",)], "path string")
    entries = spark.createDataFrame([(1, entry, None)], "entry long, file_path string, file_url string")
    assert [r.resolved for r in resolve_files(entries, listing, "entry").collect()] == [found]


@pytest.mark.parametrize("entry, found", [
    ("hdfs://nn:8020/d/a%20b.parquet", True), ("/d/a b.parquet", True), ("hdfs://other/d/a b.parquet", False),
    ("file:/d/a b.parquet", False), ("s3a://nn:8020/d/a b.parquet", False), ("hdfs:/d/a b.parquet", True),
])
def test_entries_find_files_of_other_stores(spark, entry, found):
    from nitrogrid.operators.catalog import resolve_files

    listing = spark.createDataFrame([("hdfs://nn:8020/d/a b.parquet",)], "path string")
    entries = spark.createDataFrame([(1, entry, None)], "entry long, file_path string, file_url string")
    assert [r.origin for r in resolve_files(entries, listing, "entry").collect()] == ["local" if found else None]
