import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitrogrid.operators.nearest import nearest
from nitrogrid.plans import scoring as S
from tests.conftest import watch_writes


def brute(places, sites):
    found = []
    for lat, lon in places:
        best = min(((y - lat) * (y - lat) + (x - lon) * (x - lon), k) for k, (y, x) in enumerate(sites))
        found.append(best[1])
    return found


@pytest.mark.parametrize("kind", ["even", "lattice", "hot", "far"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    places = rng.uniform((25, -125), (50, -65), size=(150, 2))
    sites = rng.uniform((25, -125), (50, -65), size=(400, 2))
    if kind == "lattice":
        # many ties, also across cell borders
        places, sites = np.round(places * 4) / 4, np.round(sites)
    if kind == "hot":
        # a third of the places and most observations at one place
        places[:50], sites[:300] = (30.0, -100.0), (30.0, -100.0)
    if kind == "far":
        places, sites = np.vstack([places, [[-360.0, 360.0], [360.0, -360.0]]]), sites[:3]
    points = spark.createDataFrame(pd.DataFrame(places, columns=["latitude", "longitude"]).rename_axis("id").reset_index())
    seen = spark.createDataFrame(pd.DataFrame(sites, columns=["latitude", "longitude"]).rename_axis("k").reset_index())
    got = nearest(points, seen.repartition(5), "k", ["k"]).orderBy("id").collect()
    assert [r.k for r in got] == brute(places.tolist(), sites.tolist())


def test_odd_rows(spark):
    points = spark.createDataFrame(
        [(1, None, 2.0), (2, float("nan"), 2.0), (3, 1.0, float("inf")), (4, 0.0, 0.0), (4, -0.0, 0.0)],
        "id int, latitude double, longitude double")
    seen = spark.createDataFrame(
        [(9, 3.0, 4.0, None), (8, 3.0, 4.0, "x"), (7, None, 0.0, "null"), (6, float("nan"), 0.0, "nan"), (5, 999.0, 0.0, "no")],
        "k int, latitude double, longitude double, note string")
    rows = sorted((r.id, r.k, r.note, r.distance) for r in nearest(points, seen, "k", ["k", "note"]).collect())
    assert rows == [(1, None, None, None), (2, None, None, None), (3, None, None, None), (4, 8, "x", 5.0), (4, 8, "x", 5.0)]


def test_empty_sides(spark):
    points = spark.createDataFrame([(1, 30.0, -100.0)], "id int, latitude double, longitude double")
    none = nearest(points, points.withColumn("k", F.lit(1)).limit(0), "k", ["k"]).first()
    assert (none.k, none.distance) == (None, None)
    assert nearest(points.limit(0), points.withColumn("k", F.lit(1)), "k", ["k"]).count() == 0


def test_cities_take_what_was_seen(spark):
    seen = spark.createDataFrame(
        [(1, 40.7, -74.0, 1, 15, None), (2, 47.0, -110.0, 12, 350, -5.0)],
        "id int, latitude double, longitude double, month int, day_of_year int, temperature double")
    rows = {r.label: r for r in S.city_observations(spark, seen, "id").collect()}
    assert len(rows) == 9
    new_york, montana = rows["New York City"], rows["Rural Montana"]
    assert (new_york.id, new_york.month, new_york.temperature, new_york.humidity) == (1, 1, 25.0, 60.0)
    assert (montana.id, montana.day_of_year, montana.temperature, montana.distance) == (2, 350, -5.0, 0.0)


@pytest.mark.parametrize("dense", [False, True])
def test_far_places_do_not_meet_all_sites(spark, monkeypatch, dense):
    """300 places far from 3,000 observations on a lattice, or in three crowded cells: 900,000 pairs in all."""
    rng = np.random.default_rng(5)
    places = np.column_stack([rng.uniform(25, 50, 300), rng.uniform(-20, -14, 300)])
    sites = np.stack(np.meshgrid(25 + np.arange(50) * 0.5, -125 + np.arange(60)), -1).reshape(-1, 2)
    if dense:
        sites = np.array([[30.0, -70.0], [40.0, -66.0], [45.0, -90.0]])[np.arange(3000) % 3] + rng.uniform(0, 0.1, (3000, 2))
    points = spark.createDataFrame(pd.DataFrame(places, columns=["latitude", "longitude"]).rename_axis("id").reset_index())
    seen = spark.createDataFrame(pd.DataFrame(sites, columns=["latitude", "longitude"]).rename_axis("k").reset_index())
    with monkeypatch.context() as patch:
        made = watch_writes(patch)
        found = nearest(points, seen, "k", ["k"])
    assert [r.k for r in found.orderBy("id").collect()] == brute(places.tolist(), sites.tolist())
    # 27,000 rows are the observations in nine cells each
    assert 300 <= max(made) <= (400_000 if dense else 27_000)


def test_many_sites_in_one_cell(spark):
    """More observed places in a cell than stand in one row, and ties between such rows."""
    spots = [(30.0 + n * 0.0005, -100.0) for n in range(200)]
    seen = spark.createDataFrame([(k, *at) for k, at in enumerate(spots)], "k int, latitude double, longitude double")
    points = spark.createDataFrame([(n, at[0], at[1] + 0.01) for n, at in enumerate(spots)], "id int, latitude double, longitude double")
    assert [r.k for r in nearest(points, seen, "k", ["k"]).orderBy("id").collect()] == list(range(200))
    between = spark.createDataFrame([(0, 30.0, -100.0)], "id int, latitude double, longitude double")
    ring = [(900 - k, 30.0 + (k % 2 * 2 - 1) * 0.0625, -100.0 + (k // 2 - 49) * 0.0009765625) for k in range(198)]
    sites = spark.createDataFrame(ring, "k int, latitude double, longitude double")
    assert nearest(between, sites, "k", ["k"]).first().k == min(k for k, _, lon in ring if lon == -100.0)
