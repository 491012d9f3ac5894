import pytest
from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.field import smooth_response
from nitrogrid.plans import scoring as S
from nitrogrid.plans import training as T


def rows(spark):
    u = lambda seed, lo, hi: F.lit(lo) + (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000) * (hi - lo)
    df = spark.range(3000).select(
        "id", u(1, 25.0, 50.0).alias("latitude"), u(2, -125.0, -65.0).alias("longitude"),
        u(3, 1.0, 13.0).cast("int").alias("month"), u(4, 1.0, 366.0).cast("int").alias("day_of_year"),
        u(5, 0.0, 2.0).cast("int").alias("is_weekend"), u(6, 0.0, 40.0).alias("temperature"),
        u(7, 0.0, 20.0).alias("wind_speed"), u(8, 20.0, 80.0).alias("humidity"),
    )
    label = smooth_response(*[F.col(c) for c in ("latitude", "longitude", "day_of_year", "is_weekend")])
    return df.withColumn("label", label)


@pytest.fixture(scope="module")
def trained(spark):
    return T.train_model(rows(spark), K.SCORING_FEATURES, "id", "quick", folds=3, numTrees=10, maxDepth=8, maxBins=32)


def test_acceptance_gate(spark, trained):
    p = trained.performance
    assert p["test_r2"] > K.R2_GATE and p["train_r2"] >= p["test_r2"] - 0.05
    assert p["train_n"] + p["test_n"] == 3000
    assert p["cv_mean"] > K.R2_GATE and 0 <= p["cv_std"] < 0.1
    row = T.performance_row(trained, spark).first()
    assert row.passed and row.accuracy_percent == pytest.approx(row.r2 * 100)


def test_predictions_keep_the_input(spark, trained):
    out = trained.predict(rows(spark))
    assert out.columns == [*rows(spark).columns, "prediction"]
    bulk = S.bulk_predictions(rows(spark).drop("label"), S.model_predictor(trained.pipeline))
    assert bulk.columns[-1] == "predicted_no2" and bulk.count() == 3000


def test_importances(spark, trained):
    ranked = T.importances(trained, spark).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 9))
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)
    assert {"day_of_year", "latitude", "longitude"} & {r.feature for r in ranked[:4]}
    top = T.importances(trained, spark, 3)
    assert top.count() == 3
    assert T.top_share(T.importances(trained, spark)).first().share == pytest.approx(sum(r.importance for r in ranked[:3]))


def test_reload_predicts_the_same(spark, trained, tmp_path):
    again = T.load_model(spark, T.save_model(trained, spark, str(tmp_path / "m")))
    a = trained.predict(rows(spark)).orderBy("id").select("prediction").collect()
    b = again.predict(rows(spark)).orderBy("id").select("prediction").collect()
    assert a == b
    assert again.features == trained.features and again.params == trained.params
    assert again.performance == pytest.approx(trained.performance)
    assert again.importance == pytest.approx(trained.importance)


def test_report_and_metadata(spark, trained):
    scored = S.score_requests(S.city_scenarios(spark), S.model_predictor(trained.pipeline), "2024-01-20 10:00:00")
    report = T.report(trained, spark, [scored])
    assert {r.section: r["count"] for r in report.groupBy("section").count().collect()} == {
        "performance": 6, "importance": 8, "Urban": 6, "Rural": 3}
    meta = T.metadata(trained, spark).first()
    assert meta.r2 == trained.performance["test_r2"] and list(meta.features) == K.SCORING_FEATURES


def test_before_a_fit(spark):
    empty = T.TrainedModel()
    assert T.importances(empty, spark).count() == 0
    assert T.metadata(empty, spark).first().status == "untrained"
    with pytest.raises(ValueError):
        empty.predict(spark.range(1))


def test_fit_does_not_depend_on_the_input_partitions(spark):
    few = [T.train_model(rows(spark).repartition(n), K.SCORING_FEATURES, "id", "quick", folds=0, numTrees=3, maxDepth=5, maxBins=32)
           for n in (2, 16)]
    a, b = (m.predict(rows(spark)).orderBy("id").select("prediction").collect() for m in few)
    assert a == b


def test_partitions_follow_the_rows():
    assert [T.partition_count(n) for n in (0, 1, 2_000_000, 2_000_001, 10 ** 11)] == [8, 8, 8, 9, 400_000]


def test_profiles():
    assert K.FOREST_PROFILES["full"] == {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 2}
    forest = T.forest(K.FOREST_PROFILES["quick"])
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getFeatureSubsetStrategy()) == (50, 15, "all")
