import pytest
from pyspark.sql import functions as F

from nitrogrid.operators import quality_states as Q
from nitrogrid.operators.quality import quality_report

SCHEMA = "source_file string, no2 double, latitude double, longitude double, time timestamp_ntz"


def observed(spark, n=3000):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit("hot")).when(i % 17 == 5, None).otherwise(F.format_string("f%02d", i % 20)).alias("source_file"),
        F.when(i % 11 == 0, None).when(i % 13 == 0, F.lit(float("nan"))).otherwise(F.lit(1e15) + (i * 7919) % 1009 * 1e6).alias("no2"),
        (F.lit(25.0) + i % 26).alias("latitude"), (F.lit(-125.0) + i % 61).alias("longitude"),
        F.timestamp_add("MINUTE", i % 900, F.to_timestamp_ntz(F.lit("2023-08-01 00:00:00"))).alias("time"))


def compare(report, wanted):
    got, exact = report.first(), wanted.first()
    assert report.columns == ["total_samples", "missing_values", "mean", "std", "min", "lat_min", "lon_min", "time_min",
                              "max", "lat_max", "lon_max", "time_max", "unique_times", "median"]
    assert sorted(report.columns) == sorted(wanted.columns)
    for c in set(report.columns) - {"unique_times", "median", "mean", "std"}:
        assert got[c] == exact[c], c
    # the values differ by parts of 1e6: sums of squares would lose the deviation
    assert got.mean == pytest.approx(exact["mean"], rel=1e-14) and got.std == pytest.approx(exact["std"], rel=1e-6)
    assert got.unique_times == pytest.approx(exact.unique_times, rel=Q.DISTINCT_BOUND)
    return got


def test_merged_states_equal_the_report(spark):
    rows = observed(spark)
    states = Q.quality_states(rows)
    assert states.count() == 22
    got = compare(Q.merged_report(states), quality_report(rows))
    clean = rows.filter("no2 IS NOT NULL AND NOT isnan(no2)")
    share = clean.agg(F.avg((F.col("no2") <= got.median).cast("int"))).first()[0]
    assert abs(share - 0.5) < Q.RANK_BOUND


def test_files_come_and_go(spark):
    rows = observed(spark)
    old = Q.quality_states(rows.filter("source_file IS NULL OR source_file <> 'f04'").withColumn(
        "no2", F.when(F.col("source_file") == "f07", F.lit(5.0)).when(F.col("source_file").isNull(), F.lit(6.0)).otherwise(F.col("no2"))))
    new = Q.quality_states(rows.filter("source_file IS NULL OR source_file IN ('f04', 'f07')"))
    states = Q.replace_states(old, new)
    compare(Q.merged_report(states), quality_report(rows))
    gone = spark.createDataFrame([("hot",), ("hot",), ("no such file",)], "source_file string")
    left = Q.without_files(states, gone)
    compare(Q.merged_report(left), quality_report(rows.filter("source_file IS NULL OR source_file <> 'hot'")))


def test_states_are_read_and_not_rows(spark, tmp_path):
    path = str(tmp_path / "states")
    Q.quality_states(observed(spark)).write.parquet(path)
    compare(Q.merged_report(spark.read.parquet(path)), quality_report(observed(spark)))


def test_no_rows_and_no_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = Q.merged_report(Q.quality_states(empty)).first()
    assert (row.total_samples, row.missing_values, row.mean, row.std, row.median, row.unique_times) == (0, 0, None, None, None, 0)
    hollow = spark.createDataFrame([("a", None, None, None, None), ("b", float("nan"), 1.0, 2.0, None)], SCHEMA)
    row = Q.merged_report(Q.quality_states(hollow)).first()
    assert (row.total_samples, row.missing_values, row.mean, row.median, row.lat_max, row.unique_times) == (2, 6, None, None, 1.0, 0)
    one = spark.createDataFrame([("a", 2.0, None, None, None)], SCHEMA)
    row = Q.merged_report(Q.quality_states(one.unionByName(hollow))).first()
    assert (row.mean, row.std, row.median) == (2.0, None, 2.0)
