"""Rows with missing values; null and NaN both count as missing."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.functions.classes import is_missing
from nitrogrid.functions.text import any_of


def missing_flag(df, name):
    """Missing test that fits the column's type (``isnan`` needs a float type)."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    return is_missing(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column.isNull()


def any_missing(df, columns=None):
    return any_of([missing_flag(df, c) for c in (columns or df.columns)])


def missing_cells(df, columns=None):
    """Number of missing cells in a row."""
    return sum((missing_flag(df, c).cast("long") for c in (columns or df.columns)), F.lit(0))


def drop_missing(df, columns=None, observation=None):
    """Keep the complete rows.

    With an ``Observation`` the counts ``rows`` and ``removed`` are collected by the same
    pass that consumes the result, so no extra scan is needed to report them.
    """
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(any_missing(df, columns)).alias("removed"),
        )
    return df.na.drop("any", subset=columns)


def missing_summary(df, columns=None):
    """One row: rows read, rows kept, rows removed, missing cells."""
    removed = any_missing(df, columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~removed).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.coalesce(F.sum(missing_cells(df, columns)), F.lit(0)).alias("missing_cells"),
    )
