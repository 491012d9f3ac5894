"""Data-quality statistics."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid.functions.classes import is_missing
from nitrogrid.operators.missing import missing_cells
from nitrogrid.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def _valid(name):
    column = F.col(f"`{name}`").cast("double")
    return F.when(~is_missing(column), column)


def quality_report(df, value="no2", lat="latitude", lon="longitude", time="time",
                   exact=True, accuracy=10_000):
    """One row: size, missing cells, value statistics, spatial and temporal extent.

    ``exact=False`` takes the median and the distinct times from mergeable sketches in the
    same single pass; the exact median adds the passes of ``exact_quantiles``.
    """
    x = _valid(value)
    distinct = F.count_distinct(time) if exact else F.approx_count_distinct(time)
    report = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum(missing_cells(df)), F.lit(0)).alias("missing_values"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.min(_valid(lat)).alias("lat_min"),
        F.max(_valid(lat)).alias("lat_max"),
        F.min(_valid(lon)).alias("lon_min"),
        F.max(_valid(lon)).alias("lon_max"),
        F.min(time).alias("time_min"),
        F.max(time).alias("time_max"),
        distinct.alias("unique_times"),
        *([] if exact else [F.percentile_approx(x, 0.5, accuracy).alias("median")]),
    )
    if not exact:
        return report
    median = exact_quantiles(df, [value], [0.5], accuracy)[value][0]
    return report.withColumn("median", F.lit(median).cast("double"))


def numeric_columns(df):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(df, columns=None, exact=True, accuracy=10_000):
    """One row per numeric column: count, mean, std, min, quartiles, max.

    One aggregate pass; exact quartiles add the passes of ``exact_quantiles``.
    """
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, QUARTILES, accuracy) if exact else None
    aggregates = []
    for c in columns:
        x = _valid(c)
        aggregates.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            *[
                (F.lit(quartiles[c][i]).cast("double") if exact else F.percentile_approx(x, p, accuracy))
                .alias(f"p{int(p * 100)}")
                for i, p in enumerate(QUARTILES)
            ],
            F.max(x).alias("max"),
        ).alias(c))
    wide = df.agg(*aggregates)
    return wide.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("s")).select("s.*")


def value_range(df, value="no2"):
    x = _valid(value)
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"))


def points_per_file(df, source="source_file", total_label="TOTAL"):
    """Rows per file plus one total row.

    Counting comes first, so the rollup expands one row per file instead of every row.
    """
    per_file = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return per_file.rollup(source).agg(F.sum("n").alias("points"), F.grouping(source).alias("g")).select(
        F.when(F.col("g") == 1, F.lit(total_label)).otherwise(F.col(source)).alias(source),
        F.coalesce("points", F.lit(0)).alias("points"),
    )


def distinct_values(df, column):
    """Sorted distinct values of a coordinate."""
    return df.select(column).distinct().orderBy(column)
