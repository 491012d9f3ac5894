"""Planar geography on latitude / longitude degrees."""

import math
from functools import reduce

from pyspark.sql import functions as F

from nitrogrid import constants as K


def planar_distance(lat, lon, lat0, lon0):
    return F.sqrt(F.pow(lat - F.lit(lat0), F.lit(2.0)) + F.pow(lon - F.lit(lon0), F.lit(2.0)))


def region_columns(lat, lon):
    return {
        "distance_from_center": planar_distance(lat, lon, K.CENTER_LAT, K.CENTER_LON),
        "is_east_coast": (lon > K.EAST_COAST_LON).cast("int"),
        "is_west_coast": (lon < K.WEST_COAST_LON).cast("int"),
        "is_northern": (lat > K.NORTHERN_LAT).cast("int"),
        "is_southern": (lat < K.SOUTHERN_LAT).cast("int"),
    }


def in_box(lat, lon, lat_lo, lat_hi, lon_lo, lon_hi):
    return lat.between(lat_lo, lat_hi) & lon.between(lon_lo, lon_hi)


def box_weight(lat, lon, boxes=None, default=0.0):
    """Weight of the first box that holds the point.

    The boxes are a parameter list, so this is one CASE expression: no join.
    """
    value = F.lit(default)
    for *box, weight in reversed(K.URBAN_BOXES if boxes is None else boxes):
        value = F.when(in_box(lat, lon, *box), F.lit(weight)).otherwise(value)
    return value


def hotspot_influence(lat, lon, hotspots=None, decay=K.HOTSPOT_DECAY_DEGREES):
    """Sum over hotspots of ``intensity * exp(-distance / decay)``."""
    terms = [
        F.lit(intensity) * F.exp(-planar_distance(lat, lon, hot_lat, hot_lon) / F.lit(decay))
        for hot_lat, hot_lon, intensity in (K.HOTSPOTS if hotspots is None else hotspots)
    ]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def cell_index(value, origin, step):
    """Integer cell of a coordinate on a regular axis; joins use this, not the float."""
    return F.round((value - F.lit(origin)) / F.lit(step)).cast("int")


def cell_value(index, origin, step):
    return F.lit(origin) + index * F.lit(step)


def axis_values(low, high, step):
    """Array of a regular axis, by integer positions so that it never passes ``high``."""
    last = math.floor((high - low) / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: cell_value(i, low, step))
