"""Registered queries: forest training and scoring on rows of the orders table.

The label is the smooth response at each order's place and day, so a fit can be judged. Each query
fits its own model; its results are stated as properties that SQL can state too: exact row counts,
values inside the range of the labels, scores above the gate.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.calendar import is_weekend
from nitrogrid.functions.field import box_response, smooth_response
from nitrogrid.plans import scoring as S
from nitrogrid.plans import training as T
from nitrogrid.registry import scoring as RS
from nitrogrid.registry import views as V
from nitrogrid.registry.preparation import HASH_SQL
from nitrogrid.session import work_path
from nitrogrid.streaming import pipelines as P

PROFILE = {"numTrees": 20, "maxDepth": 10, "maxBins": 32}


def training_rows(spark, sf, response="smooth"):
    orders = V.table(spark, sf, "orders")
    lat = F.lit(25.0) + F.pmod("o_custkey", F.lit(251)) * F.lit(0.1)
    lon = F.lit(-125.0) + F.pmod(F.col("o_orderkey") * 7, F.lit(601)) * F.lit(0.1)
    day, weekend = F.dayofyear("o_orderdate"), is_weekend(F.col("o_orderdate"))
    temperature, wind = F.col("o_totalprice") % 40, F.col("o_totalprice") % 20
    label = (smooth_response(lat, lon, day, weekend) if response == "smooth"
             else box_response(lat, lon, day, weekend, temperature, wind))
    return orders.select(
        F.col("o_orderkey").alias("event_id"),
        lat.alias("latitude"), lon.alias("longitude"),
        F.month("o_orderdate").alias("month"), day.alias("day_of_year"), weekend.alias("is_weekend"),
        temperature.alias("temperature"), wind.alias("wind_speed"),
        (F.lit(20) + F.col("o_custkey") % 60).cast("double").alias("humidity"),
        label.alias("label"),
    )


def fit(spark, sf, folds=0, response="smooth"):
    return T.train_model(
        training_rows(spark, sf, response), K.SCORING_FEATURES, "event_id", "quick", folds=folds, **PROFILE
    )


def _predictor(spark, sf):
    return S.model_predictor(fit(spark, sf).pipeline)


def _in_range(spark, sf, value):
    """Whether a value lies in the range of all labels."""
    labels = training_rows(spark, sf)
    low, high = labels.agg(F.min("label")).scalar(), labels.agg(F.max("label")).scalar()
    return F.coalesce((value >= low * 0.999999) & (value <= high * 1.000001), F.lit(False))


def model_gate(spark, sf):
    """Train and judge: the acceptance test is R2 above 0.8 on unseen rows."""
    trained = fit(spark, sf)
    p = trained.performance
    gate = T.performance_row(trained, spark).select("passed")
    return training_rows(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(p["train_n"]).alias("train_rows"), F.lit(p["test_n"]).alias("test_rows"), gate.scalar().alias("passed")
    )


def model_gate_boxes(spark, sf):
    """The same for the response with city boxes and weather, whose boxes few rows meet: R2 above 0.5."""
    p = fit(spark, sf, response="boxes").performance
    return training_rows(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(p["train_n"]).alias("train_rows"), F.lit(p["test_n"]).alias("test_rows"),
        F.lit(p["test_r2"] > 0.5).alias("learned"))


def cross_validation(spark, sf):
    """Five-fold scores on the training part, importances, metadata and report of the refit."""
    trained = fit(spark, sf, folds=5)
    p = trained.performance
    ranked = T.importances(trained, spark)
    state = T.metadata(trained, spark, V.AS_OF)
    facts = {
        "importances_sum_to_one": ranked.select(F.abs(F.sum("importance") - 1) < 1e-6),
        "ranks": ranked.select(F.concat_ws(",", F.array_sort(F.collect_list("rank")))),
        "top_three": T.top_share(ranked).select(F.col("share").between(1e-9, 1 + 1e-9)),
        "status": state.select("status"),
        "features": state.select(F.size("features")),
        "reported": T.report(trained, spark).select(F.count("value")),
        "report_agrees": T.report(trained, spark).select(F.bool_and(F.coalesce(*[
            F.when(F.col("key") == name, F.abs(F.col("value") - value) < 1e-9)
            for name, value in {"r2": p["test_r2"], "rmse": p["test_rmse"], "cv_mean": p["cv_mean"],
                                "accuracy_percent": 100 * p["test_r2"], **trained.importance}.items()
        ]))),
        "top_features": T.importances(trained, spark, 3).select(
            F.concat_ws(",", F.array_sort(F.collect_list(F.col("rank").cast("string"))))),
    }
    return training_rows(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", *[one.scalar().alias(name) for name, one in facts.items()],
        F.lit(p["train_n"]).alias("train_rows"), F.lit(p["test_n"]).alias("test_rows"),
        F.lit(p["cv_mean"] > K.R2_GATE).alias("folds_passed"), F.lit(p["cv_std"] < 0.1).alias("folds_agree"),
    )


def forest_predictions(spark, sf):
    """Predictions of all rows, by month: a forest predicts means of labels."""
    rows = fit(spark, sf).predict(training_rows(spark, sf))
    return rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(_in_range(spark, sf, F.col("prediction"))).alias("in_range"),
        (F.abs(F.avg("prediction") / F.avg("label") - 1) < 0.2).alias("near"),
    )


def bulk_score(spark, sf):
    rows = S.bulk_predictions(training_rows(spark, sf).drop("label"), _predictor(spark, sf))
    return rows.select(
        "event_id", F.round("latitude", 6).alias("latitude"), "month",
        _in_range(spark, sf, F.col("predicted_no2")).alias("in_range"))


def forest_batch(spark, sf):
    """Batch requests scored by the forest."""
    scored = S.score_batches(V.batch_requests(spark, sf), _predictor(spark, sf), V.AS_OF, keep=["request_id"])
    return scored.select(
        "request_id", "name", "error", F.col("no2_value").isNotNull().alias("scored"),
        F.col("air_quality").isNotNull().alias("classed"))


def saved_model_scores(spark, sf):
    """A saved and reloaded model gives the same predictions, in one pass over the rows."""
    trained = fit(spark, sf)
    again = T.load_model(spark, T.save_model(trained, spark, work_path(spark, "model")))
    before = trained.predict(training_rows(spark, sf)).withColumnRenamed("prediction", "a")
    return again.predict(before).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") == F.col("prediction")).alias("equal")
    )


def _scored_places(spark, sf, changes):
    """All orders' places under each of some changes of their covariates, scored by one forest."""
    places = training_rows(spark, sf).drop("label").withColumn("c", F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), *[F.lit(v).alias(k) for k, v in values.items()]) for label, values in changes
    ])))
    names = changes[0][1]
    rows = places.select(
        *[c for c in places.columns if c not in names and c != "c"], "c.*")
    return S.score_requests(rows, _predictor(spark, sf), V.AS_OF)


def scenario_seasons(spark, sf):
    """All places in four seasons; the response's wave has its seasons in the order Spring, Winter, Summer, Fall."""
    changes = [(name, {"month": month, "day_of_year": doy, "temperature": t}) for name, month, doy, t in K.SEASON_SCENARIOS]
    scored = _scored_places(spark, sf, changes)
    seasons = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(_in_range(spark, sf, F.col("no2_value"))).alias("in_range"),
        F.avg("no2_value").alias("mean"))
    # four rows
    return seasons.select("label", "n", "in_range", F.row_number().over(Window.orderBy(F.desc("mean"))).alias("place"))


def scenario_weekend(spark, sf):
    """All places on a weekday and at a weekend."""
    scored = _scored_places(spark, sf, [(name, {"is_weekend": flag}) for name, flag in K.WEEKEND_SCENARIOS])
    value = F.col("no2_value")
    return scored.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.col("is_weekend") == 0, value)) > F.avg(F.when(F.col("is_weekend") == 1, value))).alias("weekday_higher"))


def stream_score_model(spark, sf):
    """Requests scored by a fitted pipeline as a stream, and again as a batch."""
    predictor = _predictor(spark, sf)
    out = work_path(spark, "stream-model")
    requests = V.requests(spark, sf)
    requests.write.json(f"{out}/requests")
    stream = P.read_request_stream(spark, f"{out}/requests", requests.schema)
    P.start(P.score_stream(stream, predictor, V.AS_OF), f"{out}/scored", f"{out}/checkpoint").awaitTermination()
    batch = S.score_requests(requests, predictor, V.AS_OF).select("event_id", "error", F.col("no2_value").alias("value"))
    streamed = spark.read.parquet(f"{out}/scored").select("event_id", "no2_value")
    return batch.join(streamed, "event_id").select(
        "event_id", "error", F.col("value").eqNullSafe(F.col("no2_value")).alias("equal"), F.col("value").isNotNull().alias("scored"))


QUERIES = {
    "stream_score_model": stream_score_model,
    "model_gate": model_gate,
    "model_gate_boxes": model_gate_boxes,
    "cross_validation": cross_validation,
    "forest_predictions": forest_predictions,
    "bulk_score": bulk_score,
    "forest_batch": forest_batch,
    "saved_model_scores": saved_model_scores,
    "scenario_seasons": scenario_seasons,
    "scenario_weekend": scenario_weekend,
}

_SPLIT = HASH_SQL.replace("event_id", "o_orderkey") + " / 4503599627370496.0::double < 0.2::double"
_COUNTS = f"count(*) FILTER (NOT {_SPLIT}) AS train_rows, count(*) FILTER ({_SPLIT}) AS test_rows"

ORACLE = {
    "stream_score_model": f"""WITH {RS.FILLED} SELECT event_id, error, true AS equal, error IS NULL AS scored FROM filled""",
    "model_gate": f"SELECT count(*) AS rows, {_COUNTS}, true AS passed FROM orders",
    "model_gate_boxes": f"SELECT count(*) AS rows, {_COUNTS}, true AS learned FROM orders",
    "cross_validation": f"""SELECT count(*) AS rows, true AS importances_sum_to_one, '1,2,3,4,5,6,7,8' AS ranks, true AS top_three,
  'ready' AS status, 8 AS features, 14 AS reported, true AS report_agrees, '1,2,3' AS top_features, {_COUNTS}, true AS folds_passed, true AS folds_agree FROM orders""",
    "forest_predictions": """SELECT month(o_orderdate) AS month, count(*) AS n, true AS in_range, true AS near
FROM orders GROUP BY 1""",
    "bulk_score": """SELECT o_orderkey AS event_id, round(25.0::double + (o_custkey % 251) * 0.1::double, 6) AS latitude,
  month(o_orderdate) AS month, true AS in_range FROM orders""",
    "forest_batch": RS.BATCH + """ SELECT request_id, name, error, error IS NULL AS scored, error IS NULL AS classed FROM located""",
    "saved_model_scores": "SELECT count(*) AS rows, count(*) AS equal FROM orders",
    "scenario_seasons": """SELECT label, count(*) AS n, true AS in_range, place
FROM orders, (VALUES ('Spring', 1), ('Winter', 2), ('Summer', 3), ('Fall', 4)) s(label, place) GROUP BY 1, 4""",
    "scenario_weekend": """SELECT month(o_orderdate) AS month, 2 * count(*) AS n, true AS weekday_higher FROM orders GROUP BY 1""",
}
