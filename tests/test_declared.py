"""Declared axes, tiles filled by position, repeatable day writes, and box tables, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nitrogrid.functions.geo import box_weight
from nitrogrid.operators import declared as A
from nitrogrid.operators.boxes import first_box
from nitrogrid.operators.grid import flatten_grid, valid_blocks
from nitrogrid.sinks.grids import write_declared_grid
from nitrogrid.sources.granules import read_blocks
from tests.conftest import most_rows, plan_text, watch_writes

LAT, LON = A.Axis.between(25.0, 27.0, 0.5), A.Axis.between(-125.0, -124.0, 0.25)
SCHEMA = "event_id int, date date, latitude double, longitude double, no2 double"


def rows(rng, n, days=3):
    nan = float("nan")
    found = [(i, dt.date(2023, 8, 1 + rng.randrange(days)), rng.uniform(24.4, 28), rng.uniform(-125.5, -123.5), rng.choice([None, 1.0 * i]))
             for i in range(n)]
    return [*found, (n, dt.date(2023, 8, 1), nan, -125.0, 3.0), (n + 1, dt.date(2023, 8, 9), None, -125.0, 3.0)]


def brute(data, absent=0.0):
    cells, seen = {}, {}
    for date in {r[1] for r in data}:
        for i in range(LAT.size):
            for j in range(LON.size):
                cells[date, i, j] = absent
    for event, date, la, lo, v in data:
        if la is None or not 25.0 <= la < 27.5 or not -125.0 <= lo < -123.75:
            continue
        at = date, int((la - 25.0) // 0.5), int((lo + 125.0) // 0.25)
        if seen.get(at, -1) < event:
            seen[at], cells[at] = event, v
    return cells


@pytest.mark.parametrize("band", [1, 2, 3, 64])
def test_tiles_hold_every_cell(spark, band):
    data = rows(random.Random(band), 200)
    tiles = A.declared_tiles(spark.createDataFrame(data, SCHEMA), LAT, LON, rows_per_tile=band)
    assert all(len(t["values"]) == t["lat_rows"] * LON.size for t in tiles.collect())
    got = {(r.date, r.lat_index, r.lon_index): r.no2 for r in A.tile_cells(tiles, LAT, LON).collect()}
    assert got == brute(data)


def test_off_grid_rows_are_the_rest(spark):
    data = rows(random.Random(5), 300)
    df = spark.createDataFrame(data, SCHEMA)
    inside = df.filter(LAT.position(F.col("latitude")).isNotNull() & LON.position(F.col("longitude")).isNotNull())
    assert inside.count() + A.off_grid(df, LAT, LON).count() == len(data)
    assert A.off_grid(df, LAT, LON).filter("latitude IS NULL OR isnan(latitude)").count() == 2


def test_no_rows_no_tiles(spark):
    assert A.declared_tiles(spark.createDataFrame([], SCHEMA), LAT, LON).count() == 0


def test_plan_has_no_join_and_no_subquery(spark):
    text = plan_text(A.declared_tiles(spark.createDataFrame(rows(random.Random(1), 9), SCHEMA), LAT, LON))
    assert "Join" not in text and "Subquery" not in text and "partial_max_by" in text


def test_days_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "grid")
    data = rows(random.Random(2), 120)
    df = spark.createDataFrame(data, SCHEMA)
    for _ in range(2):
        write_declared_grid(df, path, LAT, LON, rows_per_tile=2)
    later = spark.createDataFrame([(1, dt.date(2023, 8, 2), 25.0, -125.0, 77.0)], SCHEMA)
    write_declared_grid(later, path, LAT, LON, rows_per_tile=2)
    want = {**brute(data), **brute([(1, dt.date(2023, 8, 2), 25.0, -125.0, 77.0)])}
    back = flatten_grid(valid_blocks(read_blocks(spark, path)), drop=False).collect()
    assert len(back) == len(want)
    got = {(r.time.date(), round((r.latitude - 25) / 0.5), round((r.longitude + 125) / 0.25)): r.no2 for r in back}
    assert got == want
    assert all(len(list(day.glob("part-*"))) == 1 for day in (tmp_path / "grid").glob("day=*"))


def test_boxes_of_a_table_as_the_case_form(spark):
    rng = random.Random(4)
    edge = lambda: rng.choice([rng.uniform(-90, 90), float(rng.randint(-3, 3)), 0.125 * rng.randint(-9, 9)])
    boxes = []
    for k in range(60):
        la, lo, size = edge(), edge(), rng.choice([0.0, 0.01, 1.0, 7.0, 60.0, 400.0])
        boxes.append((k, la, la + size, lo, lo + rng.choice([0.0, size, 3 * size]), float(k)))
    boxes += [(70, 3.0, 2.0, 0.0, 9.0, 70.0), (71, None, 2.0, 0.0, 9.0, 71.0)]
    points = [(i, edge(), edge()) for i in range(400)]
    points += [(400 + k, b[1], b[4]) for k, b in enumerate(boxes[:60])]  # corners
    points += [(900, None, 1.0), (901, float("nan"), 0.0)]
    table = spark.createDataFrame(boxes, "priority int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, weight double")
    df = spark.createDataFrame(points, "event_id int, latitude double, longitude double").repartition(3)
    got = {r.event_id: r.weight for r in first_box(df, table, "event_id").collect()}
    case = box_weight(F.col("latitude"), F.col("longitude"), [b[1:] for b in boxes[:60]], -1.0)
    want = {r.event_id: None if r.w == -1.0 else r.w for r in df.select("event_id", case.alias("w")).collect()}
    assert got == want and len(got) == len(points)


def test_no_boxes(spark):
    table = spark.createDataFrame([], "priority int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, weight double")
    df = spark.createDataFrame([(1, 2.0, 3.0)], "event_id int, latitude double, longitude double")
    assert [tuple(r) for r in first_box(df, table, "event_id").collect()] == [(1, 2.0, 3.0, None, None)]


def test_points_do_not_meet_all_boxes_that_hold_them(spark, monkeypatch):
    """3,000 points at 300 places in 800 wide boxes: 408,000 pairs of a point and a box that holds it."""
    rng = random.Random(11)
    spots = [(25 + rng.randrange(100) * 0.25, -125 + rng.randrange(100) * 0.5) for _ in range(300)]
    points = [(k, *spots[k % 300]) for k in range(3000)]
    boxes = []
    for k in range(800):
        lat, lon = rng.uniform(20, 40), rng.uniform(-130, -85)
        boxes.append((rng.randrange(400), lat, lat + rng.uniform(5, 15), lon, lon + rng.uniform(20, 30), float(k)))
    df = spark.createDataFrame(points, "event_id int, latitude double, longitude double")
    table = spark.createDataFrame(boxes, "priority int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, weight double")
    with monkeypatch.context() as patch:
        made = watch_writes(patch)
        found = first_box(df, table, "event_id")
        made.append(most_rows(found))
    def held(la, lo):
        return min(((b[0], b[5]) for b in boxes if b[1] <= la <= b[2] and b[3] <= lo <= b[4]), default=(None, None))

    assert {r.event_id: (r.priority, r.weight) for r in found.collect()} == {k: held(la, lo) for k, la, lo in points}
    assert 3000 <= max(made) <= 20_000


def test_odd_points_and_boxes(spark):
    inf, nan = float("inf"), float("nan")
    points = [(1, 2.0, 2.0), (1, 9.0, 9.0), (2, 9.0, 9.0), (3, inf, 2.0), (3, inf, 2.0), (4, -inf, 2.0), (None, 2.0, 2.0),
              (5, nan, 2.0), (6, None, 2.0), (7, -0.0, 0.0), (8, 5e9, -5e9), (9, 50.0, 50.0)]
    boxes = [(5, 1.0, 3.0, 1.0, 3.0, 1.0), (4, 8.0, 9.0, 9.0, 9.0, None), (4, 8.0, 9.0, 9.0, 9.0, 2.0), (6, 0.0, 0.0, -0.0, 0.0, 3.0),
             (7, 4e9, 6e9, -6e9, -4e9, 4.0), (None, 50.0, 60.0, 50.0, 60.0, 5.0), (1, 50.0, 60.0, 50.0, 60.0, 6.0),
             (0, 3.0, 1.0, 1.0, 3.0, 7.0), (0, None, 3.0, 1.0, 3.0, 8.0)]
    df = spark.createDataFrame(points, "event_id int, latitude double, longitude double")
    table = spark.createDataFrame(boxes, "priority int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, weight double")
    got = sorted(((r.event_id, r.latitude, r.priority, r.weight) for r in first_box(df, table, "event_id").collect()), key=str)
    held = {1: (4, None), 2: (4, None), 7: (6, 3.0), 8: (7, 4.0), 9: (None, 5.0)}
    assert str(got) == str(sorted(((k, la, *held.get(k, (None, None))) for k, la, _ in points), key=str))
    assert first_box(df.filter("event_id > 90"), table, "event_id").count() == 0
