import json
import shutil

import pytest
from pyspark.sql import functions as F

from nitrogrid.operators.air_quality import class_dimension, classify, with_display
from nitrogrid.plans import scoring as S
from nitrogrid.registry import scoring as queries
from nitrogrid.schemas import BATCH_REQUEST, SCORE_REQUEST
from nitrogrid.sinks.replies import batch_replies, single_replies, write_replies
from nitrogrid.sources.requests import parse_requests, read_batch_requests, read_requests
from nitrogrid.streaming import pipelines as P

AS_OF = "2024-01-20 10:00:00"  # a Saturday


def requests(spark, *points):
    rows = [(lat, lon, None, None, None, None, None, None, None) for lat, lon in points]
    return spark.createDataFrame(rows, SCORE_REQUEST)


@pytest.mark.parametrize("lat,lon,error", [
    (25.0, -125.0, None), (50.0, -65.0, None), (24.999, -100.0, "latitude must be between 25 and 50"),
    (50.001, 0.0, "latitude must be between 25 and 50"), (30.0, -125.001, "longitude must be between -125 and -65"),
    (30.0, -64.999, "longitude must be between -125 and -65"), (None, -100.0, "latitude and longitude are required"),
    (99.0, None, "latitude and longitude are required"), (float("nan"), -100.0, "latitude must be between 25 and 50"),
])
def test_validation(spark, lat, lon, error):
    row = S.score_requests(requests(spark, (lat, lon)), S.formula_predictor(), AS_OF).first()
    assert row.error == error
    assert (row.no2_value is None) == (error is not None)
    assert (row.air_quality is None) == (error is not None)


def test_defaults_come_from_the_given_moment(spark):
    row = S.with_defaults(requests(spark, (40.0, -100.0)), AS_OF).first()
    assert (row.month, row.day_of_year, row.is_weekend) == (1, 20, 1)
    assert (row.temperature, row.wind_speed, row.humidity) == (25.0, 10.0, 60.0)
    now = S.with_defaults(requests(spark, (40.0, -100.0))).select(
        "month", F.month(F.current_timestamp()).alias("m")).first()
    assert now.month == now.m


def test_given_covariates_stay(spark):
    df = spark.createDataFrame([(40.0, -100.0, "x", 8, 220, 0, 1.0, 2.0, 3.0)], SCORE_REQUEST)
    row = S.with_defaults(df, AS_OF).first()
    assert (row.month, row.day_of_year, row.is_weekend, row.temperature) == (8, 220, 0, 1.0)


def test_unknown_formula():
    with pytest.raises(ValueError):
        S.formula_predictor("other")


def test_requests_and_replies_as_json(spark, tmp_path):
    bodies = spark.createDataFrame(
        [(1, '{"latitude": 40.0, "longitude": -100, "month": 8, "day_of_year": 365, "is_weekend": 0}'),
         (2, '{"latitude": 60, "longitude": -100}'), (3, "not json"), (4, '{"longitude": -100}')],
        "id int, body string",
    )
    scored = S.score_requests(parse_requests(bodies, keep=["id"]), S.formula_predictor(), AS_OF)
    replies = {r.id: r for r in single_replies(scored, keep=["id"]).collect()}
    assert replies[1].success and replies[1].prediction.no2_value == pytest.approx(1.7e15)
    assert replies[1].prediction.air_quality == "MODERATE_POLLUTION"
    assert (replies[2].success, replies[2].error) == (False, "latitude must be between 25 and 50")
    assert {replies[3].error, replies[4].error} == {"latitude and longitude are required"}
    path = write_replies(single_replies(scored, keep=["id"]), str(tmp_path / "replies"))
    assert spark.read.json(path).filter("success").count() == 1


def batch(spark, tmp_path):
    body = {
        "locations": [
            {"latitude": 40.7128, "longitude": -74.0060, "name": "NYC"}, {"latitude": 34.0, "longitude": None},
            {"latitude": 60.0, "longitude": -100.0}, {"latitude": 34.0522, "longitude": -118.2437, "name": "LA"},
        ],
        "month": 8, "day_of_year": 220, "is_weekend": 0,
    }
    (tmp_path / "batch.json").write_text(json.dumps(body) + "\n" + json.dumps({"locations": []}) + "\n")
    return read_batch_requests(spark, str(tmp_path / "batch.json"))


def test_batch(spark, tmp_path):
    rows = S.score_batches(batch(spark, tmp_path), S.formula_predictor(), AS_OF).collect()
    assert [(r.name, r.error is None, r.day_of_year, r.has_locations) for r in rows[:4]] == [
        ("NYC", True, 220, True), ("Unknown", False, 220, True), ("Unknown", False, 220, True), ("LA", True, 220, True)]
    assert len(rows) == 5 and rows[4].latitude is None and rows[4].has_locations
    loose = S.score_batches(batch(spark, tmp_path), S.formula_predictor(), AS_OF, range_check=False).collect()
    assert sum(r.error is None and r.no2_value is not None for r in loose) == 3


def test_batch_replies(spark, tmp_path):
    numbered = batch(spark, tmp_path).withColumn("request_id", F.when(F.col("month") == 8, 1).otherwise(2))
    scored = S.score_batches(numbered, S.formula_predictor(), AS_OF, keep=["request_id"], range_check=False)
    replies = batch_replies(scored.withColumn("position", F.col("longitude"))).collect()
    found = {r.request_id: r for r in replies}
    assert {k: (r.success, r["count"], r.error) for k, r in found.items()} == {1: (True, 3, None), 2: (True, 0, None)}
    assert [p.name for p in found[1].predictions] == ["LA", "Unknown", "NYC"]


def test_every_batch_is_answered(spark):
    place = '{"latitude": 40.0, "longitude": -74.0}'
    bodies = ['{"locations": []}', '{"month": 1}', '{"locations": [{"name": "x"}]}', f'{{"locations": [{place}]}}', "no JSON"]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    scored = S.score_batches(parse_requests(df, schema=BATCH_REQUEST, keep=["request_id"]), S.formula_predictor(), AS_OF,
                             keep=["request_id"]).withColumn("position", F.col("longitude"))
    found = {r.request_id: (r.success, r["count"], r.error) for r in batch_replies(scored).collect()}
    missing = (False, None, "locations array is required")
    assert found == {0: (True, 0, None), 1: missing, 2: (True, 0, None), 3: (True, 1, None), 4: missing}


def test_scenarios(spark):
    cities = S.city_scenarios(spark)
    assert cities.count() == 9 and cities.filter("scenario = 'Rural'").count() == 3
    seasons = {r.label: r.temperature for r in S.season_scenarios(spark).collect()}
    assert seasons == {"Winter": 20.0, "Spring": 25.0, "Summer": 25.0, "Fall": 25.0}
    scored = S.score_requests(S.weekend_scenarios(spark), S.formula_predictor(), AS_OF)
    assert S.weekend_effect(scored).first().difference == pytest.approx(0.2e15)


def test_dimension(spark):
    assert class_dimension(spark).count() == 4
    df = spark.createDataFrame([(1.2e15,), (None,)], "no2_value double")
    rows = with_display(classify(df)).collect()
    low = next(r for r in rows if r.no2_value)
    assert (low.color, low.display_colour, low.emoji) == ("#44AA44", "yellow", "🟢")
    none = next(r for r in rows if r.no2_value is None)
    assert (none.display_name, none.display_colour, none.emoji) == (None, "primary", "🌫️")
    other = df.select(F.lit("ODD").alias("air_quality"), F.lit("text").alias("air_quality_text"))
    assert with_display(other).first().display_name == "text"


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        requests(spark, (30.0 + part, -100.0), (10.0, -100.0 - part), (None, 1.0 * part)).write.mode(
            "append").json(source)
    predictor = S.formula_predictor("boxes")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = P.score_stream(P.read_request_stream(spark, source, files_per_trigger=1), predictor, AS_OF)
    P.start(stream, out, mark).awaitTermination()
    wanted = S.score_requests(read_requests(spark, source), predictor, AS_OF)
    order = sorted(wanted.columns)
    as_rows = lambda df: sorted(map(str, df.select(order).collect()))
    assert as_rows(spark.read.parquet(out)) == as_rows(wanted)
    # a restart with the same checkpoint reads only new files
    requests(spark, (44.0, -70.0)).write.mode("append").json(source)
    again = P.score_stream(P.read_request_stream(spark, source), predictor, AS_OF)
    P.start(again, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 10 == read_requests(spark, source).count()


def test_block_stream(spark, tmp_path):
    from nitrogrid.operators.grid import flatten_grid
    from tests.test_grid import block, blocks

    source = str(tmp_path / "in")
    blocks(spark, block("a"), block("b", no2=[1.0])).write.parquet(source)
    out = str(tmp_path / "out")
    P.start(P.flatten_stream(P.read_block_stream(spark, source)), out, str(tmp_path / "mark")).awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).select("source_file", "no2", "latitude").collect()))
    batch_rows = flatten_grid(spark.read.parquet(source)).select("source_file", "no2", "latitude")
    assert got == sorted(map(str, batch_rows.collect())) and len(got) == 6


def test_batch_schema_covers_the_request():
    assert BATCH_REQUEST.names[0] == "locations" and "humidity" in BATCH_REQUEST.names


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_flatten_reads_a_table_of_files(spark, tmp_path, files):
    """The table is one file or a folder of files, and may have no rows."""
    table = spark.range(6).select(
        F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding"), F.lit(1).alias("label"))
    table = table.filter("vec_id < 0").coalesce(1) if files == 0 else table.repartition(files)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.stream_flatten(spark, str(tmp_path))
    assert {r.vec_id: r["count"] for r in rows.groupBy("vec_id").count().collect()} == ({n: 64 for n in range(6)} if files else {})
    if files == 1:
        part = next((tmp_path / "embeddings.parquet").glob("part-*.parquet"))
        (tmp_path / "one").mkdir()
        shutil.copy(part, tmp_path / "one" / "embeddings.parquet")
        assert sorted(queries.stream_flatten(spark, str(tmp_path / "one")).collect()) == sorted(rows.collect())
