"""Threshold classes: air quality and model performance."""

from pyspark.sql import functions as F

from nitrogrid import constants as K


def is_missing(column):
    """Null or NaN. Only valid for float and double columns."""
    return column.isNull() | F.isnan(column)


def banded(value, bands, missing=None):
    """First band whose exclusive lower bound lies below ``value``.

    ``bands`` is ``[(bound, label), ..., (None, label)]``, highest bound first. A missing
    value gets ``missing``; without that guard NaN would land in the highest band.
    """
    *bounded, (_, label) = bands
    chain = F.when(is_missing(value), F.lit(missing))
    for bound, name in bounded:
        chain = chain.when(value > F.lit(bound), F.lit(name))
    return chain.otherwise(F.lit(label))


def air_quality_code(value):
    return banded(value, [(bound, code) for bound, code, _, _ in K.AIR_QUALITY_CLASSES])


def air_quality_text(value):
    return banded(value, [(bound, text) for bound, _, text, _ in K.AIR_QUALITY_CLASSES])


def air_quality_colour(value):
    return banded(value, [(bound, colour) for bound, _, _, colour in K.AIR_QUALITY_CLASSES])


def performance_level(r2):
    return banded(r2, K.PERFORMANCE_LEVELS)


def passes_gate(r2, gate=K.R2_GATE):
    return F.coalesce(r2 > F.lit(gate), F.lit(False)) & ~F.isnan(F.coalesce(r2, F.lit(0.0)))
