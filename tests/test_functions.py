import math

import pytest
from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions import calendar, classes, field, geo, text
from nitrogrid.functions.hashing import fold, key_hash, unit_hash


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_calendar_of_a_saturday(spark):
    t = F.lit("2023-08-05 13:30:00").cast("timestamp_ntz")
    row = one(spark, **calendar.calendar_columns(t))
    assert row.asDict() == {
        "year": 2023, "month": 8, "day": 5, "hour": 13, "day_of_year": 217,
        "day_of_week": 5, "is_weekend": 1, "season": 2,
    }


def test_week_starts_on_monday(spark):
    week = [calendar.day_of_week(F.date_add(F.lit("2023-07-31").cast("date"), i)) for i in range(7)]
    assert list(one(spark, **{f"d{i}": c for i, c in enumerate(week)})) == list(range(7))


def test_seasons(spark):
    row = one(spark, **{f"m{m}": calendar.season(F.lit(m)) for m in range(1, 13)})
    assert list(row) == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]


def test_leap_day_of_year(spark):
    assert one(spark, d=F.dayofyear(F.lit("2024-12-31").cast("date"))).d == 366


def test_region_flags_are_strict(spark):
    at = geo.region_columns(F.lit(40.0), F.lit(-80.0))
    row = one(spark, **at)
    assert (row.is_east_coast, row.is_northern, row.distance_from_center) == (0, 0, 20.0)
    past = one(spark, **geo.region_columns(F.lit(29.999), F.lit(-120.001)))
    assert (past.is_west_coast, past.is_southern, past.is_east_coast) == (1, 1, 0)


@pytest.mark.parametrize("lat,lon,weight", [
    (40.0, -75.0, 2.0), (41.0, -73.0, 2.0), (33.0, -117.0, 1.8), (41.0, -87.5, 1.6),
    (41.01, -73.0, 0.0), (42.0, -88.0, 1.6),
])
def test_boxes_are_inclusive(spark, lat, lon, weight):
    assert one(spark, w=geo.box_weight(F.lit(lat), F.lit(lon))).w == weight


def test_first_box_wins(spark):
    boxes = [(0, 10, 0, 10, 3.0), (5, 15, 5, 15, 4.0)]
    assert one(spark, w=geo.box_weight(F.lit(7.0), F.lit(7.0), boxes)).w == 3.0


def test_axis_never_passes_the_bound(spark):
    row = one(spark, a=geo.axis_values(25.0, 50.0, 0.2), b=geo.axis_values(25.0, 50.0, 0.1))
    assert len(row.a) == 126 and row.a[-1] == pytest.approx(50.0)
    assert len(row.b) == 251 and row.b[-1] == pytest.approx(50.0)


def test_hotspot_influence_against_plain_python(spark):
    expected = sum(i * math.exp(-math.hypot(39 - a, -98 - o) / 2) for a, o, i in K.HOTSPOTS)
    assert one(spark, v=geo.hotspot_influence(F.lit(39.0), F.lit(-98.0))).v == pytest.approx(expected)


def test_field_has_a_floor_and_a_weekend(spark):
    far = one(spark, v=field.expected_field(F.lit(50.0), F.lit(-125.0), F.lit(80), F.lit(0)),
              a=field.expected_field(F.lit(40.7128), F.lit(-74.006), F.lit(80), F.lit(0)),
              b=field.expected_field(F.lit(40.7128), F.lit(-74.006), F.lit(80), F.lit(1)))
    assert far.v == K.FIELD_FLOOR
    assert far.b / far.a == pytest.approx(0.8)


def test_smooth_response_at_the_centre(spark):
    value = one(spark, v=field.smooth_response(F.lit(40.0), F.lit(-100.0), F.lit(365), F.lit(0))).v
    assert value == pytest.approx(1.7e15)


def test_box_response(spark):
    args = [F.lit(x) for x in (40.5, -74.0, 365, 1, 40.0, 30.0)]
    expected = 1e15 + 2 * 0.5e15 + 0.3e15 + 0.7 * 0.2e15 + 1.1 * 0.1e15
    assert one(spark, v=field.box_response(*args)).v == pytest.approx(expected)


def test_class_thresholds_are_strict(spark):
    values = [2e15, 2.0000001e15, 1.5e15, 1.50001e15, 1e15, 1.0001e15, 0.0]
    row = one(spark, **{f"v{i}": classes.air_quality_code(F.lit(v)) for i, v in enumerate(values)})
    assert list(row) == [
        "MODERATE_POLLUTION", "HIGH_POLLUTION", "LOW_POLLUTION", "MODERATE_POLLUTION",
        "CLEAN_AIR", "LOW_POLLUTION", "CLEAN_AIR",
    ]


def test_missing_values_have_no_class(spark):
    row = one(spark, a=classes.air_quality_code(F.lit(float("nan"))),
              b=classes.air_quality_colour(F.lit(None).cast("double")))
    assert list(row) == [None, None]


def test_documented_example(spark):
    x = F.lit(1.06e15)
    row = one(spark, a=classes.air_quality_code(x), b=classes.air_quality_text(x), c=classes.air_quality_colour(x))
    assert list(row) == ["LOW_POLLUTION", "Low Pollution", "#44AA44"]


def test_performance_levels(spark):
    values = [0.951, 0.95, 0.9, 0.8, 0.7, -3.0]
    row = one(spark, **{f"v{i}": classes.performance_level(F.lit(v)) for i, v in enumerate(values)})
    assert list(row) == ["EXCELLENT", "VERY GOOD", "GOOD", "FAIR", "NEEDS IMPROVEMENT", "NEEDS IMPROVEMENT"]
    gate = one(spark, a=classes.passes_gate(F.lit(0.8)), b=classes.passes_gate(F.lit(0.81)),
               c=classes.passes_gate(F.lit(float("nan"))), d=classes.passes_gate(F.lit(None).cast("double")))
    assert list(gate) == [False, True, False, False]


@pytest.mark.parametrize("url,name", [
    ("https://h.example/a/b.nc?x=1#y", "b.nc"), ("https://h.example/a/", "tempo_file_4.nc"),
    ("https://h.example", "tempo_file_4.nc"), ("https://h.example/a/b.NC", "tempo_file_4.nc"),
    ("not a url at all", "tempo_file_4.nc"), ("a/b.nc", "b.nc"),
])
def test_download_names(spark, url, name):
    assert one(spark, n=text.download_file_name(F.lit(url), F.lit(3))).n == name


def test_small_text_functions(spark):
    row = one(
        spark, a=text.title_from_snake(F.lit("no2_products")), b=text.scientific(F.lit(1.06e15)),
        c=text.fixed3(F.lit(40.7128)), d=text.na_to_null(F.lit("N/A")), e=text.na_to_null(F.lit("Na")),
        f=text.blank_to_null(F.lit("  ")), g=text.blank_to_null(F.lit(" x ")),
        h=text.stamp(F.lit("2024-10-04 12:00:05").cast("timestamp")),
    )
    assert list(row) == ["No2 Products", "1.06e+15", "40.713", None, "Na", None, "x", "20241004_120005"]


def test_hashes_depend_on_key_and_seed_only(spark):
    df = spark.range(1000)
    columns = [key_hash(F.col("id"), 1).alias("h"), unit_hash(F.col("id"), 1).alias("u"), fold(F.col("id"), 5, 1).alias("f")]
    a = sorted(map(tuple, df.select("id", *columns).collect()))
    b = sorted(map(tuple, df.repartition(7).select("id", *columns).collect()))
    assert a == b
    assert all(0 <= u < 1 for _, _, u, _ in a)
    assert {f for _, _, _, f in a} == set(range(5))
    other = df.select(key_hash(F.col("id"), 2)).collect()
    assert [r[0] for r in other] != [h for _, h, _, _ in a]
