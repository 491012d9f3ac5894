"""Observations to scaled, split feature rows (no model)."""

from nitrogrid import constants as K
from nitrogrid.operators.features import (
    available_features, select_features, spatial_features, temporal_features, weather_features,
)
from nitrogrid.operators.scale import scale_features
from nitrogrid.operators.split import split_rows


def feature_table(observations, key, target="no2", weather=None, on=("date",)):
    """Calendar, region and weather features with ``label``."""
    df = spatial_features(temporal_features(observations))
    df = weather_features(df, weather, on)
    return select_features(df, K.PREPROCESSING_FEATURES, target, keys=[key])


def prepared_table(observations, key, target="no2", weather=None, on=("date",),
                   test_size=0.2, val_size=0.2, kind="standard"):
    """Feature table with a ``split`` column, scaled on the training part."""
    table = feature_table(observations, key, target, weather, on)
    features = available_features(table, K.PREPROCESSING_FEATURES)
    return scale_features(split_rows(table, key, test_size, val_size), features, kind)
