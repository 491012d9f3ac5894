import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitrogrid.operators import densify as D
from nitrogrid.operators import grid as G
from nitrogrid.operators.lineage import union_all, with_file_index
from nitrogrid.schemas import GRID_BLOCK, OBSERVATION
from nitrogrid.sinks.grids import write_grid
from nitrogrid.sources.granules import read_blocks

DAYS = [dt.datetime(2023, 8, 1), dt.datetime(2023, 8, 2)]
NAN = float("nan")


def block(name="g1", time=DAYS[:1], lat=(25.0, 26.0), lon=(-125.0, -124.0, -123.0), no2=None):
    if no2 is None:
        no2 = [float(i) for i in range(len(time) * len(lat) * len(lon))]
    as_list = lambda v: None if v is None else list(v)
    return (name, as_list(time), as_list(lat), as_list(lon), as_list(no2), {"units": "molecules/cm^2"}, {"title": "t"})


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), GRID_BLOCK)


def test_flatten_is_row_major_with_all_time_steps(spark):
    rows = G.flatten_grid(blocks(spark, block(time=DAYS))).collect()
    assert len(rows) == 12
    expected = {
        (float(t * 6 + a * 3 + o), 25.0 + a, -125.0 + o, DAYS[t])
        for t in range(2) for a in range(2) for o in range(3)
    }
    assert {(r.no2, r.latitude, r.longitude, r.time) for r in rows} == expected


def test_size_mismatch_is_rejected_not_fatal(spark):
    checked = G.validate_blocks(blocks(spark, block(), block("bad", time=DAYS, no2=[1.0] * 6)))
    assert [tuple(r) for r in G.rejected_blocks(checked).collect()] == [("bad", "sizes of variables differ")]
    assert {r.source_file for r in G.flatten_grid(checked.drop("error")).collect()} == {"g1"}


def test_single_time_is_repeated(spark):
    rows = G.flatten_grid(blocks(spark, block())).collect()
    assert {r.time for r in rows} == {DAYS[0]} and len(rows) == 6


def test_gaps_are_dropped(spark):
    rows = G.flatten_grid(blocks(spark, block(no2=[1.0, NAN, None, 4.0, 5.0, 6.0])))
    assert sorted(r.no2 for r in rows.collect()) == [1.0, 4.0, 5.0, 6.0]


def test_strict_needs_every_variable(spark):
    checked = G.validate_blocks(blocks(spark, block("a", lat=None, no2=[1.0]), block("b", time=None, no2=[1.0])))
    assert dict(map(tuple, G.rejected_blocks(checked).collect())) == {
        "a": "missing variable: latitude", "b": "missing variable: time",
    }


def test_lenient_keeps_what_exists(spark):
    df = blocks(
        spark,
        block("no value", no2=None),
        block("no grid", time=DAYS, lat=None, no2=[7.0, NAN]),
        block("no time", time=None, no2=[1.0, NAN, 3.0, 4.0, 5.0, 6.0]),
        block("only value", time=None, lat=None, lon=None, no2=[8.0, NAN]),
    )
    df = df.withColumn("no2", F.when(F.col("source_file") != "no value", F.col("no2")))
    rows = G.flatten_grid(df, "lenient").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_file, []).append((r.no2, r.latitude, r.longitude, r.time))
    assert len(by["no value"]) == 6 and all(v[0] is None and v[1] is not None for v in by["no value"])
    assert by["no grid"] == [(7.0, None, None, DAYS[0])]
    assert len(by["no time"]) == 5 and all(v[3] is None for v in by["no time"])
    assert by["only value"] == [(8.0, None, None, None)]


def test_empty_block_gives_no_rows(spark):
    assert G.flatten_grid(blocks(spark, block(lat=[], no2=[]))).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        G.flatten_grid(blocks(spark, block()), "other")


def random_block(name, nt, nlat, nlon, seed):
    values = np.random.default_rng(seed).normal(size=nt * nlat * nlon)
    values[::7] = NAN
    return block(
        name, [dt.datetime(2023, 8, 1 + i) for i in range(nt)],
        [25.0 + 0.5 * i for i in range(nlat)], [-125.0 + 0.5 * i for i in range(nlon)], values.tolist(),
    )


def as_set(rows):
    return sorted(tuple(r) for r in rows.select("source_file", "no2", "latitude", "longitude", "time").collect())


def test_box_equals_filter_and_tiles_equal_blocks(spark):
    df = blocks(spark, random_block("a", 2, 9, 7, 1), random_block("b", 1, 4, 11, 2)).cache()
    box = (25.5, 27.0, -124.5, -122.0)
    everything = G.flatten_grid(df)
    wanted = as_set(everything.filter(
        F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:])
    ))
    assert as_set(G.flatten_grid(df, bbox=box)) == wanted and wanted
    tiles = G.tile_blocks(df, 2)
    assert as_set(G.flatten_grid(tiles)) == as_set(everything)
    assert as_set(G.flatten_grid(G.tiles_in_box(tiles, box), bbox=box)) == wanted
    assert tiles.count() == 2 * 5 + 2
    df.unpersist()


def test_box_without_points(spark):
    assert G.flatten_grid(blocks(spark, block()), bbox=(0.0, 1.0, 0.0, 1.0)).count() == 0


def test_aliases_prefer_the_full_name():
    found = G.find_variables(["lat", "latitude", "lon", "NO2", "x"])
    assert found == {"no2": ["NO2"], "latitude": ["latitude", "lat"], "longitude": ["lon"], "time": []}


def test_aliases_are_chosen_per_block(spark):
    full = blocks(spark, block("a"))
    short = blocks(spark, block("b")).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    both = full.unionByName(short, allowMissingColumns=True)
    assert G.rejected_blocks(G.validate_blocks(G.extract_variables(both))).count() == 0
    assert G.flatten_grid(G.extract_variables(both)).groupBy("source_file").count().count() == 2


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_a_block_without_variables_is_rejected(spark, mode):
    empty = blocks(spark, block("x")).withColumns({c: F.lit(None).cast(t) for c, t in (
        ("no2", "array<float>"), ("latitude", "array<double>"), ("longitude", "array<double>"), ("time", "array<timestamp_ntz>"))})
    assert G.rejected_blocks(G.validate_blocks(empty, mode)).count() == 1


def test_lenient_box(spark):
    df = blocks(spark, block("no time", time=None, no2=[1.0] * 6), block("no grid", lat=None, no2=[1.0] * 6), block("all"))
    rows = G.flatten_grid(df, "lenient", bbox=(20.0, 50.0, -130.0, -60.0)).collect()
    by = {n: [r for r in rows if r.source_file == n] for n in ("no time", "no grid", "all")}
    assert [r.time for r in by["no time"]] == [None] * 6 and len(by["all"]) == 6 and not by["no grid"]


def test_structure_lists_everything(spark):
    rows = G.dataset_structure(blocks(spark, block(time=DAYS))).collect()
    found = {(r.kind, r["name"]): (r["shape"], r.dtype, r.attrs) for r in rows}
    assert found["dimension", "latitude"] == ("2", None, {})
    assert found["coordinate", "time"] == ("2", "timestamp_ntz", {})
    assert found["variable", "no2"] == ("2,2,3", "float", {"units": "molecules/cm^2"})
    assert found["attribute", "title"] == (None, None, {"value": "t"})
    assert len(rows) == 8


def observations(spark):
    rows = [
        (1, dt.date(2023, 8, 1), 25.0, -125.0, 5.0), (2, dt.date(2023, 8, 1), 25.0, -125.0, 6.0),
        (3, dt.date(2023, 8, 2), 26.0, -124.0, 7.0), (4, dt.date(2023, 8, 1), 26.0, -125.0, 8.0),
    ]
    return spark.createDataFrame(rows, "event_id int, date date, latitude double, longitude double, no2 double")


def test_densify_last_wins_and_absent_is_zero(spark):
    cells = {
        (str(r.date), r.latitude, r.longitude): r.no2 for r in D.densify(observations(spark)).collect()
    }
    assert len(cells) == 8
    assert cells["2023-08-01", 25.0, -125.0] == 6.0
    assert cells["2023-08-02", 26.0, -124.0] == 7.0
    assert sum(cells.values()) == 21.0


@pytest.mark.parametrize("band", [1, 2, 64])
def test_dense_tiles_hold_the_dense_grid(spark, band):
    tiles = D.dense_tiles(observations(spark), rows_per_tile=band)
    flat = G.flatten_grid(tiles).collect()
    dense = D.densify(observations(spark)).collect()
    assert sorted((str(r.time.date()), r.latitude, r.longitude, r.no2) for r in flat) == sorted(
        (str(r.date), r.latitude, r.longitude, r.no2) for r in dense
    )


def test_flatten_then_densify_gives_the_grid_back(spark):
    values = np.random.default_rng(3).normal(size=2 * 5 * 4).astype("float32").tolist()
    source = blocks(spark, block("x", DAYS, [25.0 + i for i in range(5)], [-125.0 + i for i in range(4)], values))
    rows = G.flatten_grid(source).withColumns({"date": F.to_date("time"), "event_id": F.lit(1)})
    tiles = D.dense_tiles(rows, rows_per_tile=5).orderBy("time").collect()
    assert [t.latitude for t in tiles] == [[25.0 + i for i in range(5)]] * 2
    assert sum((list(t.no2) for t in tiles), []) == values


def test_written_grid_reads_back(spark, tmp_path):
    path = write_grid(observations(spark), str(tmp_path / "grid"), rows_per_tile=1)
    checked = read_blocks(spark, path)
    assert checked.filter(F.col("error").isNotNull()).count() == 0
    row = checked.first()
    assert row.var_attrs["units"] == "molecules/cm^2" and "created" in row.ds_attrs
    assert G.flatten_grid(checked.drop("error")).agg(F.sum("no2")).first()[0] == 21.0


def test_file_index_leaves_gaps(spark):
    checked = G.validate_blocks(blocks(spark, block("a"), block("b", no2=[1.0]), block("c")))
    rows = with_file_index(G.flatten_grid(checked.drop("error")), checked)
    assert {(r.source_file, r.file_index) for r in rows.collect()} == {("a", 0), ("c", 2)}


def test_union_of_nothing_and_of_unlike_frames(spark):
    empty = union_all([], OBSERVATION, spark)
    assert empty.count() == 0 and empty.columns == OBSERVATION.names
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(2))
    assert sorted(map(tuple, union_all([a, b]).select("x", "y").collect()), key=str) == [(1, None), (None, 2)]


def test_regular_grid_size(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-08-01', DATE'2023-08-03')) AS date")
    grid = G.regular_grid(days, 5.0)
    assert grid.count() == 3 * 6 * 13
    assert not math.isnan(grid.agg(F.max("longitude")).first()[0])
