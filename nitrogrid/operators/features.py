"""Feature columns and feature selection."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.calendar import calendar_columns
from nitrogrid.functions.field import temperature_baseline
from nitrogrid.functions.geo import region_columns

# used where no weather row matches; temperature falls back to the seasonal baseline
WEATHER_FALLBACK = {"wind_speed": K.DEFAULT_WIND_SPEED, "humidity": K.DEFAULT_HUMIDITY, "pressure": 1013.0}


def temporal_features(df, time="time"):
    parsed = F.col(time).cast("timestamp_ntz")
    return df.withColumns({"datetime": parsed, **calendar_columns(parsed)})


def spatial_features(df, lat="latitude", lon="longitude"):
    return df.withColumns(region_columns(F.col(lat), F.col(lon)))


def interaction_features(df):
    """Products of feature pairs, for the pairs that are present."""
    pairs = {
        "lat_lon_interaction": ("latitude", "longitude"),
        "temp_humidity_interaction": ("temperature", "humidity"),
    }
    return df.withColumns({
        name: F.col(a) * F.col(b)
        for name, (a, b) in pairs.items() if a in df.columns and b in df.columns
    })


def weather_features(df, weather=None, on=("date",), fallback=None):
    """Weather columns from a weather table, with fallbacks where it has no row.

    The weather table is averaged to one row per key first, so the join never multiplies
    rows. Without a table only the fallbacks are used. Needs ``day_of_year``.
    """
    fallback = {**WEATHER_FALLBACK, **(fallback or {})}
    measures = ["temperature", *fallback]
    given = []
    if weather is not None:
        given = [m for m in measures if m in weather.columns]
        unique = weather.groupBy(*on).agg(*[F.avg(m).alias(f"_{m}") for m in given])
        df = df.join(unique, list(on), "left")
    defaults = {
        "temperature": temperature_baseline(F.col("day_of_year")),
        **{m: F.lit(v) for m, v in fallback.items()},
    }
    filled = {
        m: F.coalesce(F.col(f"_{m}"), defaults[m]) if m in given else defaults[m] for m in measures
    }
    return df.withColumns(filled).drop(*[f"_{m}" for m in given])


def model_features(df, weather=None, on=("date",), date="date"):
    """Calendar, region, weather and interaction columns of the full model."""
    calendar = calendar_columns(F.col(date))
    wanted = {k: calendar[k] for k in ("year", "month", "day", "day_of_year", "day_of_week", "is_weekend")}
    df = spatial_features(df.withColumns(wanted))
    return interaction_features(weather_features(df, weather, on))


def select_features(df, features, target="no2", keys=()):
    """The listed features that exist, plus the target as ``label``."""
    present = available_features(df, features)
    return df.select(*keys, *present, F.col(target).cast("double").alias("label"))


def available_features(df, features):
    return [c for c in features if c in df.columns]
