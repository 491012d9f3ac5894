import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from nitrogrid.operators import quality
from nitrogrid.operators.features import (
    interaction_features, model_features, select_features, temporal_features, weather_features,
)
from nitrogrid.operators.metrics import regression_metrics, with_verdict
from nitrogrid.operators.missing import drop_missing, missing_summary
from nitrogrid.operators.partitioning import spread
from nitrogrid.operators.quantiles import exact_quantiles, value_at_share
from nitrogrid.sinks.tables import as_json, column_types, preview, write_csv, write_observations

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def column(spark, values):
    return spark.createDataFrame(pd.DataFrame({"x": np.asarray(values, dtype=float)})).repartition(5)


@pytest.mark.parametrize("kind", ["normal", "hot", "constant", "few", "wide"])
def test_distributed_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=4000),
        # one value holds more than a third of the rows
        "hot": np.concatenate([np.full(1500, 3.0), rng.normal(3, 5, size=2500)]),
        "constant": np.full(3000, 7.5),
        "few": np.array([5.0, 1.0, 9.0]),
        "wide": 10.0 ** rng.uniform(-300, 300, size=3000),
    }[kind]
    # accuracy 100 and no small-table path: brackets and buckets are really used
    found = exact_quantiles(column(spark, values), ["x"], PROBS, accuracy=100)["x"]
    assert found == pytest.approx([float(v) for v in np.quantile(values, PROBS)], rel=1e-9)


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    for small in (0, 100):
        assert exact_quantiles(df, ["x"], [0.5]) == {"x": [2.0]}
    empty = df.filter("x > 10")
    for small in (0, 100):
        assert exact_quantiles(empty, ["x"], [0.5]) == {"x": [None]}


def test_value_at_share(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("v"))
    assert value_at_share(df, "v", 0.25, lambda n: 249, accuracy=100) == (2, 200, 100, 249)
    assert value_at_share(df.filter("v > 100"), "v", 0.25, lambda n: 0) is None


def frame(spark):
    rows = [
        (1, 1.0, 10.0, -100.0, "2023-08-05 13:00:00"), (2, 2.0, 20.0, -90.0, "2023-08-05 13:00:00"),
        (3, None, 30.0, -80.0, "2023-08-06 00:00:00"), (4, float("nan"), 40.0, None, None),
        (5, 6.0, 50.0, -60.0, "2023-12-31 23:59:59"),
    ]
    return spark.createDataFrame(rows, "id int, no2 double, latitude double, longitude double, t string").select(
        "id", "no2", "latitude", "longitude", F.col("t").cast("timestamp_ntz").alias("time")
    )


def test_quality_report_counts_null_and_nan(spark):
    row = quality.quality_report(frame(spark)).first()
    assert (row.total_samples, row.missing_values, row.unique_times) == (5, 4, 3)
    assert (row["mean"], row["min"], row["max"], row["median"]) == (3.0, 1.0, 6.0, 2.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 6], ddof=1))
    assert (row.lat_min, row.lat_max, row.lon_min, row.lon_max) == (10.0, 50.0, -100.0, -60.0)
    sketch = quality.quality_report(frame(spark), exact=False).first()
    assert sketch["median"] == 2.0 and sketch.unique_times == 3


def test_describe_equals_pandas(spark):
    found = {r.column: r for r in quality.describe(frame(spark)).collect()}
    pdf = frame(spark).select("id", "no2", "latitude", "longitude").toPandas()
    for name, expected in pdf.describe().items():
        r = found[name]
        values = [r["count"], r["mean"], r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]]
        assert values == pytest.approx(list(expected))
    sketch = {r.column: r for r in quality.describe(frame(spark), exact=False).collect()}
    assert sketch["id"].p50 == 3.0


def test_drop_missing_reports_in_the_same_pass(spark):
    watch = Observation("missing")
    kept = drop_missing(frame(spark), observation=watch)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 5]
    assert watch.get == {"rows": 5, "removed": 2}
    assert tuple(missing_summary(frame(spark)).first()) == (5, 3, 2, 4)
    assert drop_missing(frame(spark), ["latitude"]).count() == 5


def test_points_and_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "source_file string")
    assert {r.source_file: r.points for r in quality.points_per_file(df).collect()} == {"a": 2, "b": 1, "TOTAL": 3}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (3.0, 2.0, "a"), (5.0, 5.0, "b"), (5.0, 5.0, "b")],
                               "label double, prediction double, g string")
    rows = {r.g: r for r in with_verdict(regression_metrics(df, by=["g"])).collect()}
    assert (rows["a"].r2, rows["a"].mae) == (0.5, 0.5) and rows["a"].rmse == pytest.approx(0.5 ** 0.5)
    assert (rows["b"].r2, rows["b"].level, rows["b"].passed) == (1.0, "EXCELLENT", True)
    assert regression_metrics(df).count() == 1


def test_features_and_selection(spark):
    df = temporal_features(frame(spark).filter("id = 1")).withColumn("temperature", F.lit(2.0))
    row = interaction_features(df).first()
    assert row.lat_lon_interaction == -1000.0 and "temp_humidity_interaction" not in row
    assert select_features(df, ["season", "nothing", "latitude"], keys=["id"]).columns == [
        "id", "season", "latitude", "label"]
    made = model_features(frame(spark).filter("id = 1").withColumn("date", F.to_date("time"))).first()
    assert (made.wind_speed, made.humidity, made.pressure, made.is_weekend) == (10.0, 60.0, 1013.0, 1)
    assert made.temp_humidity_interaction == pytest.approx(made.temperature * 60)


def test_weather_never_multiplies_rows(spark):
    df = spark.range(100).select(
        "id", F.lit("2023-08-01").alias("date"), F.lit(10).alias("day_of_year"),
        F.lit(1.0).alias("latitude"), F.col("id").cast("double").alias("longitude"),
    )
    weather = spark.createDataFrame([("2023-08-01", 10.0), ("2023-08-01", 20.0), ("2023-08-02", 1.0)],
                                    "date string, temperature double")
    rows = weather_features(df, weather).collect()
    assert len(rows) == 100 and {r.temperature for r in rows} == {15.0} and {r.humidity for r in rows} == {60.0}


def test_weather_joins_a_stream(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "'2023-08-01' as date", "10 as day_of_year")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    weather = spark.createDataFrame([("2023-08-01", 10.0)], "date string, temperature double")
    query = weather_features(stream, weather).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("temperature = 10").count() == 10


def test_spread(spark):
    assert spread(spark.range(3), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_table_sinks(spark, tmp_path):
    out = write_csv(frame(spark), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(out).count() == 5
    path = write_observations(frame(spark), str(tmp_path / "obs"), "time")
    day = spark.read.parquet(path).filter("date = DATE'2023-08-05'")
    assert day.count() == 2
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in preview(frame(spark), F.desc("id"), 2).collect()] == [5, 4]
    assert [(r.column, r.type) for r in column_types(frame(spark)).collect()][0] == ("id", "int")
    assert as_json(frame(spark).filter("id = 1").select("id", "time")).first()[0] == (
        '{"id":1,"time":"2023-08-05T13:00:00.000"}')
