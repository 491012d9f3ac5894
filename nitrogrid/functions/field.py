"""Deterministic parts of the concentration field, as column expressions."""

import math

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.geo import box_weight, hotspot_influence


def annual_sine(day_of_year, shift=0):
    """One sine wave a year; the divisor stays 365 in leap years."""
    return F.sin(F.lit(2 * math.pi) * (day_of_year - F.lit(shift)) / F.lit(K.DAYS_PER_YEAR))


def temperature_baseline(day_of_year):
    return F.lit(20.0) + F.lit(10.0) * annual_sine(day_of_year)


def seasonal_factor(day_of_year):
    return F.lit(1.0) + F.lit(0.3) * annual_sine(day_of_year, shift=80)


def weekly_factor(weekend):
    return F.when(weekend == 1, F.lit(0.8)).otherwise(F.lit(1.0))


def floored(value, floor=K.FIELD_FLOOR):
    return F.greatest(value, F.lit(floor))


def expected_field(lat, lon, day_of_year, weekend, hotspots=None):
    """Hotspot influence x season x week, never below the floor."""
    return floored(
        hotspot_influence(lat, lon, hotspots)
        * seasonal_factor(day_of_year)
        * weekly_factor(weekend)
    )


def smooth_response(lat, lon, day_of_year, weekend):
    """Response with one smooth spatial bump around the centre of the box."""
    squared = F.pow(lat - F.lit(K.CENTER_LAT), F.lit(2.0)) + F.pow(lon - F.lit(K.CENTER_LON), F.lit(2.0))
    return (
        F.lit(1e15)
        + F.lit(0.5e15) * F.exp(-squared / F.lit(100.0))
        + F.lit(0.3e15) * annual_sine(day_of_year)
        + F.lit(0.2e15) * (F.lit(1) - weekend)
    )


def box_response(lat, lon, day_of_year, weekend, temperature, wind_speed, boxes=None):
    """Response with urban boxes, season, week and weather terms."""
    season = F.lit(1.0) + F.lit(0.4) * annual_sine(day_of_year)
    week = F.when(weekend == 1, F.lit(0.7)).otherwise(F.lit(1.0))
    weather = (
        F.lit(1.0)
        + F.lit(0.2) * (temperature / F.lit(40.0))
        - F.lit(0.1) * (wind_speed / F.lit(30.0))
    )
    return floored(
        F.lit(1e15)
        + box_weight(lat, lon, boxes) * F.lit(0.5e15)
        + season * F.lit(0.3e15)
        + week * F.lit(0.2e15)
        + weather * F.lit(0.1e15)
    )
