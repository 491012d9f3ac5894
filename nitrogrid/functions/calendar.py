"""Calendar columns derived from a timestamp or date column."""

from pyspark.sql import functions as F


def day_of_week(time):
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(time)


def is_weekend(time):
    return (F.weekday(time) >= 5).cast("int")


def season(month):
    """0 winter (Dec-Feb), 1 spring, 2 summer, 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


def calendar_columns(time):
    """Ordered name -> column for all calendar features of ``time``."""
    return {
        "year": F.year(time),
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "hour": F.hour(time),
        "day_of_year": F.dayofyear(time),
        "day_of_week": day_of_week(time),
        "is_weekend": is_weekend(time),
        "season": season(F.month(time)),
    }


def date_spine(first, last):
    """Array of all days from ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr("interval 1 day"))
