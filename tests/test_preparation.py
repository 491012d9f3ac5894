import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.operators import split as S
from nitrogrid.operators.scale import scale_features, scaler_statistics
from nitrogrid.plans.preprocessing import prepared_table


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(5000)
    a = dict(map(tuple, S.split_rows(df, "id", 0.2, 0.2).collect()))
    b = dict(map(tuple, S.split_rows(df.repartition(13), "id", 0.2, 0.2).collect()))
    assert a == b
    sizes = {r.split: r.rows for r in S.split_sizes(S.split_rows(df, "id", 0.2, 0.2)).collect()}
    assert sum(sizes.values()) == 5000
    assert sizes["test"] == pytest.approx(1000, abs=120) and sizes["val"] == pytest.approx(1000, abs=120)


@pytest.mark.parametrize("n,share", [(1, 0.2), (7, 0.3), (10, 0.2), (999, 0.2), (1000, 0.3)])
def test_exact_split_sizes(spark, n, share):
    parts = S.split_rows_exact(spark.range(n).repartition(4), "id", share, accuracy=50)
    sizes = {r.split: r.rows for r in S.split_sizes(parts).collect()}
    assert sizes["test"] == math.ceil(n * share) and sum(sizes.values()) == n


def test_exact_split_with_equal_hashes(spark, monkeypatch):
    # every hash collides: the keys decide
    monkeypatch.setattr(S, "key_hash", lambda key, seed: F.lit(5).cast("bigint"))
    parts = S.split_rows_exact(spark.range(10), "id", 0.3).collect()
    assert sorted(r.id for r in parts if r.split == "test") == [0, 1, 2]


def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(a), 4.0, "train" if i % 4 else "test") for i, a in enumerate(rng.normal(5, 3, 200))]
    return spark.createDataFrame(data, "id int, a double, c double, split string")


def test_standard_scaling_uses_population_deviation_of_the_training_part(spark):
    data = rows(spark).toPandas()
    train = data[data.split == "train"].a
    expected = ((data.a - train.mean()) / train.std(ddof=0)).tolist()
    scaled = scale_features(rows(spark), ["a", "c"]).orderBy("id").toPandas()
    assert scaled.a.tolist() == pytest.approx(expected)
    assert set(scaled.c) == {0.0}


def test_minmax_scaling(spark):
    data = rows(spark).toPandas()
    train = data[data.split == "train"].a
    scaled = scale_features(rows(spark), ["a", "c"], "minmax", prefix="s_").orderBy("id").toPandas()
    assert scaled.s_a.tolist() == pytest.approx(((data.a - train.min()) / (train.max() - train.min())).tolist())
    assert set(scaled.s_c) == {0.0}
    whole = scale_features(rows(spark), ["a"], "minmax", fit_on=None).agg(F.min("a"), F.max("a")).first()
    assert tuple(whole) == (0.0, 1.0)


def test_unknown_scaler(spark):
    with pytest.raises(ValueError):
        scale_features(rows(spark), ["a"], "robust")
    with pytest.raises(ValueError):
        scaler_statistics(rows(spark), ["a"], "robust")


def test_prepared_table(spark):
    obs = spark.range(400).select(
        "id", (F.col("id") % 25 + 25.0).alias("latitude"), (F.lit(-125.0) + F.col("id") % 60).alias("longitude"),
        F.timestamp_add("HOUR", F.col("id") * 7, F.lit("2023-08-01 00:00:00").cast("timestamp_ntz")).alias("time"),
        (F.col("id") * 1e13).alias("no2"),
    )
    table = prepared_table(obs, "id")
    assert table.columns == ["id", *K.PREPROCESSING_FEATURES, "label", "split"]
    train = table.filter("split = 'train'").agg(F.avg("hour"), F.stddev_pop("hour"), F.max("pressure")).first()
    assert tuple(train) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)
