"""Scoring requests: validation, defaults, prediction, class."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.calendar import is_weekend
from nitrogrid.functions.field import box_response, smooth_response
from nitrogrid.operators.air_quality import classify
from nitrogrid.operators.nearest import nearest
from nitrogrid.sources.requests import explode_batches


def with_range_error(df, range_check=True):
    """Add ``error``: the first failed test of a request, null when it is valid."""
    lat, lon = F.col("latitude"), F.col("longitude")
    chain = F.when(lat.isNull() | lon.isNull(), F.lit(K.MESSAGE_COORDINATES_REQUIRED))
    if range_check:
        # NaN is outside every range
        chain = chain.when(~lat.between(K.LAT_MIN, K.LAT_MAX), F.lit(K.MESSAGE_LATITUDE_RANGE))
        chain = chain.when(~lon.between(K.LON_MIN, K.LON_MAX), F.lit(K.MESSAGE_LONGITUDE_RANGE))
    return df.withColumn("error", chain)


def with_defaults(df, as_of=None):
    """Fill absent covariates; the calendar ones from ``as_of`` (default: now)."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    defaults = {
        "month": F.month(now), "day_of_year": F.dayofyear(now), "is_weekend": is_weekend(now),
        "temperature": F.lit(K.DEFAULT_TEMPERATURE),
        "wind_speed": F.lit(K.DEFAULT_WIND_SPEED),
        "humidity": F.lit(K.DEFAULT_HUMIDITY),
    }
    return df.withColumns({
        c: F.coalesce(c, v) if c in df.columns else v for c, v in defaults.items()
    })


def formula_predictor(kind="smooth"):
    """Predictor made of a closed formula; same contract as ``model_predictor``."""
    lat, lon = F.col("latitude"), F.col("longitude")
    doy, weekend = F.col("day_of_year"), F.col("is_weekend")
    if kind == "smooth":
        value = smooth_response(lat, lon, doy, weekend)
    elif kind == "boxes":
        value = box_response(lat, lon, doy, weekend, F.col("temperature"), F.col("wind_speed"))
    else:
        raise ValueError("kind must be 'smooth' or 'boxes'")
    return lambda df: df.withColumn("no2_value", value)


def model_predictor(model):
    """Predictor made of a fitted pipeline; only the value column is kept."""
    def predict(df):
        out = model.transform(df)
        return out.select(*df.columns, F.col("prediction").alias("no2_value"))
    return predict


def score_requests(df, predictor, as_of=None, range_check=True):
    """Score request rows. Rejected rows stay, with ``error`` and no prediction.

    Works on batch and streaming frames: one narrow projection plus the predictor.
    """
    checked = with_defaults(with_range_error(df, range_check), as_of)
    # the predictor needs present coordinates on every row
    usable = checked.withColumns({
        "_lat": F.col("latitude"), "_lon": F.col("longitude"),
        "latitude": F.coalesce("latitude", F.lit(K.CENTER_LAT)),
        "longitude": F.coalesce("longitude", F.lit(K.CENTER_LON)),
    })
    scored = predictor(usable).withColumns({
        "latitude": F.col("_lat"), "longitude": F.col("_lon"),
        "no2_value": F.when(F.col("error").isNull(), F.col("no2_value")),
    }).drop("_lat", "_lon")
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    return classify(scored).withColumn("timestamp", stamp)


def score_batches(batches, predictor, as_of=None, keep=(), range_check=True, position=None):
    """Score every location of batch requests.

    A missing name becomes the default. A location without coordinates, or outside the box where
    ``range_check`` is on, stays with its ``error`` and no prediction; so does a request without
    locations, as one row. ``position`` names a column for the place in the request's list.
    """
    rows = explode_batches(batches, keep, position)
    rows = rows.withColumn("name", F.coalesce("name", F.lit(K.DEFAULT_LOCATION_NAME)))
    return score_requests(rows, predictor, as_of, range_check)


def bulk_predictions(df, predictor):
    """Keep every input column and add ``predicted_no2``."""
    return predictor(df).withColumnRenamed("no2_value", "predicted_no2")


def _scenario_rows(spark, rows):
    covariates = ("scenario", "label", "latitude", "longitude", "month", "day_of_year",
                  "is_weekend", "temperature", "wind_speed", "humidity")
    values = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" + ("D" if isinstance(v, float) else "")
                        for v in row) + ")"
        for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS s({', '.join(covariates)})")


def city_scenarios(spark):
    """Cities and rural places at fixed summer covariates."""
    fixed = (K.SCENARIO_MONTH, K.SCENARIO_DAY_OF_YEAR, 0,
             K.DEFAULT_TEMPERATURE, K.DEFAULT_WIND_SPEED, K.DEFAULT_HUMIDITY)
    return _scenario_rows(spark, [
        (area, name, lat, lon, *fixed) for name, lat, lon, area in K.CITY_SCENARIOS
    ])


def city_observations(spark, observations, tie, covariates=K.SCENARIO_COVARIATES):
    """The cities with the covariates of their nearest observations, and the ``distance`` to them.

    Covariates that the observations lack, or have no value for, keep the fixed summer ones.
    """
    cities = city_scenarios(spark)
    given = [c for c in covariates if c in observations.columns]
    seen = observations.select(tie, "latitude", "longitude", *[F.col(c).alias(f"_seen_{c}") for c in given])
    near = nearest(cities, seen, tie, [tie, *[f"_seen_{c}" for c in given]])
    return near.withColumns({
        c: F.coalesce(F.col(f"_seen_{c}").cast(cities.schema[c].dataType), F.col(c)) for c in given
    }).drop(*[f"_seen_{c}" for c in given])


def season_scenarios(spark):
    """One place in four seasons."""
    return _scenario_rows(spark, [
        ("season", name, K.SCENARIO_LAT, K.SCENARIO_LON, month, doy, 0, temperature,
         K.DEFAULT_WIND_SPEED, K.DEFAULT_HUMIDITY)
        for name, month, doy, temperature in K.SEASON_SCENARIOS
    ])


def weekend_scenarios(spark):
    """One place on a weekday and at a weekend."""
    return _scenario_rows(spark, [
        ("weekend", name, K.SCENARIO_LAT, K.SCENARIO_LON, K.SCENARIO_MONTH,
         K.SCENARIO_DAY_OF_YEAR, flag, K.DEFAULT_TEMPERATURE, K.DEFAULT_WIND_SPEED,
         K.DEFAULT_HUMIDITY)
        for name, flag in K.WEEKEND_SCENARIOS
    ])


def weekend_effect(scored):
    """Weekday value minus weekend value of scored weekend scenarios."""
    value = F.col("no2_value")
    return scored.agg(
        F.max(F.when(F.col("is_weekend") == 0, value)).alias("weekday"),
        F.max(F.when(F.col("is_weekend") == 1, value)).alias("weekend"),
    ).withColumn("difference", F.col("weekday") - F.col("weekend"))
