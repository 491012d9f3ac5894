"""Forest training, evaluation, importances, reports, persistence."""

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from nitrogrid import constants as K
from nitrogrid.functions.hashing import fold
from nitrogrid.operators.metrics import regression_metrics, with_verdict
from nitrogrid.operators.scale import scaler_statistics
from nitrogrid.operators.split import split_rows

SCALED = "_scaled_"


@dataclass
class TrainedModel:
    """A fitted pipeline with its metrics; everything here is metrics-sized."""

    pipeline: PipelineModel = None
    features: list = field(default_factory=list)
    params: dict = field(default_factory=dict)
    performance: dict = field(default_factory=dict)
    importance: dict = field(default_factory=dict)

    def predict(self, df):
        if self.pipeline is None:
            raise ValueError("the model is not trained")
        return self.pipeline.transform(df).drop("features", *[SCALED + c for c in self.features])


def scaler_stage(training, features, kind="standard"):
    """A pipeline stage that scales with statistics of the training rows.

    The statistics are two numbers per feature. As a SQL stage it is saved with the model.
    """
    row = scaler_statistics(training, features, kind).first()
    terms = ", ".join(
        f"(CAST({c} AS DOUBLE) - ({row[c]['shift']!r}D)) / ({row[c]['scale']!r}D) AS {SCALED}{c}"
        for c in features
    )
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def forest(params):
    settings = {
        "featuresCol": "features", "labelCol": "label", "featureSubsetStrategy": "all",
        "maxBins": 64, "seed": K.SEED, **params,
    }
    return RandomForestRegressor(**settings)


# the fewest partitions of training rows, and the rows a partition holds on average at most
PARTITIONS = 8
ROWS_PER_PARTITION = 250_000


def partition_count(rows, least=PARTITIONS, each=ROWS_PER_PARTITION):
    """Partitions for so many training rows: a function of the data, not of the machine."""
    return max(least, -(-rows // each))


def train_model(df, features, key, profile="full", test_size=0.2, folds=5, seed=K.SEED,
                partitions=None, parallelism=None, **params):
    """Split, scale, cross-validate and fit on ``label``; metrics on train and test.

    Cross-validation runs on the training part only, ``parallelism`` fits at a time (default: all
    folds), and its final refit on the whole training part is the model, so nothing is fitted twice.
    A fit samples rows by partition, so the training rows are dealt by a hash of the key to a number
    of ``partitions`` that follows from the row count unless it is given, and ordered there: the
    model does not depend on the machine or on how the table was split, and a partition does not
    grow with the table.
    """
    settings = {**K.FOREST_PROFILES[profile], **params}
    parts = split_rows(df, key, test_size, seed=seed)
    train = parts.filter(F.col("split") == "train")
    partitions = partitions or partition_count(train.count())
    prepare = Pipeline(stages=[
        scaler_stage(train, features),
        VectorAssembler(inputCols=[SCALED + c for c in features], outputCol="features"),
    ]).fit(train)
    fold_column = [fold(F.col(key), folds, seed).alias("fold")] if folds else []
    ready = prepare.transform(
        train.repartition(partitions, key).sortWithinPartitions(key)
    ).select("features", "label", *fold_column).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        estimator = forest(settings)
        if folds:
            search = CrossValidator(
                estimator=estimator, estimatorParamMaps=[{}], numFolds=folds, foldCol="fold",
                evaluator=RegressionEvaluator(labelCol="label", metricName="r2"), parallelism=parallelism or folds,
            ).fit(ready)
            model = search.bestModel
            cv = {"cv_mean": search.avgMetrics[0], "cv_std": search.stdMetrics[0]}
        else:
            model, cv = estimator.fit(ready), {}
    finally:
        ready.unpersist()
    trained = TrainedModel(
        PipelineModel(stages=[*prepare.stages, model]), list(features), settings,
        importance=dict(zip(features, model.featureImportances.toArray().tolist())),
    )
    trained.performance = {**_split_metrics(trained, parts), **cv}
    return trained


def _split_metrics(trained, parts):
    """Metrics of both parts from one scoring pass."""
    rows = regression_metrics(trained.predict(parts), by=["split"]).collect()  # two rows
    return {
        f"{r['split']}_{m}": r[m] for r in rows for m in ("n", "r2", "rmse", "mae")
    }


def importances(trained, spark, top_n=None):
    """Rows ``rank, feature, importance``; none before a fit."""
    rows = sorted(trained.importance.items())
    table = spark.createDataFrame(rows, "feature string, importance double")
    # one row per feature
    ranked = table.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("importance"), F.asc("feature"))
    ))
    return ranked.filter(F.col("rank") <= top_n) if top_n else ranked


def top_share(ranked, n=3):
    """Share of the n most important features."""
    return ranked.filter(F.col("rank") <= n).agg(
        F.coalesce(F.sum("importance"), F.lit(0.0)).alias("share")
    )


def performance_row(trained, spark):
    """One row: test metrics, cross-validation, level and gate."""
    p = trained.performance
    names = ["test_r2", "test_rmse", "test_mae", "cv_mean", "cv_std"]
    row = spark.createDataFrame(
        [[float(p[n]) if n in p else None for n in names]],
        "r2 double, rmse double, mae double, cv_mean double, cv_std double",
    )
    return with_verdict(row.withColumn("accuracy_percent", F.col("r2") * 100))


def report(trained, spark, scenarios=()):
    """Long report: rows ``section, key, value`` of performance, importances, scenarios.

    ``scenarios`` are scored scenario frames.
    """
    performance = performance_row(trained, spark)
    numbers = ["r2", "rmse", "mae", "cv_mean", "cv_std", "accuracy_percent"]
    rows = performance.select(F.explode(F.array(*[
        F.struct(F.lit("performance").alias("section"), F.lit(n).alias("key"),
                 F.col(n).cast("double").alias("value"))
        for n in numbers
    ])).alias("r")).select("r.*")
    ranked = importances(trained, spark)
    rows = rows.unionByName(ranked.select(
        F.lit("importance").alias("section"), F.col("feature").alias("key"),
        F.col("importance").alias("value"),
    ))
    for scored in scenarios:
        rows = rows.unionByName(scored.select(
            F.col("scenario").alias("section"), F.col("label").alias("key"),
            F.col("no2_value").alias("value"),
        ))
    return rows


def metadata(trained, spark, as_of=None):
    """One row that describes the model; accuracy is the measured R2."""
    moment = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    table = spark.createDataFrame(
        [("RandomForestRegressor", trained.features, json.dumps(trained.performance),
          json.dumps(trained.params), trained.performance.get("test_r2"),
          "ready" if trained.pipeline is not None else "untrained")],
        "model_type string, features array<string>, performance string, params string, "
        "r2 double, status string",
    )
    return table.withColumn("created_at", moment)


def save_model(trained, spark, path):
    """The fitted pipeline plus one metadata row, so a reloaded model can predict."""
    trained.pipeline.write().overwrite().save(f"{path}/pipeline")
    metadata(trained, spark).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_model(spark, path):
    row = spark.read.json(f"{path}/metadata").first()
    pipeline = PipelineModel.load(f"{path}/pipeline")
    features = list(row["features"])
    importance = dict(zip(features, pipeline.stages[-1].featureImportances.toArray().tolist()))
    return TrainedModel(
        pipeline, features, json.loads(row["params"]), json.loads(row["performance"]), importance
    )
