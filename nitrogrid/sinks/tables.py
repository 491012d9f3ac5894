"""Table sinks and previews."""

from pyspark.sql import functions as F

from nitrogrid.functions.text import stamp


def default_name(spark, prefix, as_of=None):
    """``prefix_YYYYmmdd_HHMMSS``."""
    moment = F.current_timestamp() if as_of is None else F.lit(as_of)
    return spark.range(1).select(F.concat(F.lit(f"{prefix}_"), stamp(moment))).first()[0]


def write_csv(df, path=None, prefix="no2_combined_data", mode="errorifexists"):
    """CSV folder with headers; every task writes its own part."""
    path = path or default_name(df.sparkSession, prefix)
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_observations(df, path, date=None, mode="errorifexists"):
    """Parquet, partitioned by day so that later date filters skip files.

    Rows are rebalanced by day first, so a day has few files; a day with many rows is split by
    size and not gathered in one task.
    """
    writer = df.withColumn("date", F.to_date(date)).hint("rebalance", "date") if date else df
    out = writer.write.mode(mode)
    (out.partitionBy("date") if date else out).parquet(path)
    return path


def write_catalog_report(categorised, counts, sections, path, mode="errorifexists"):
    """The catalog report as JSON: entries partitioned by category, sizes, instructions."""
    texts = categorised.select(
        "category", *[F.col(c) for c in categorised.columns if c != "category"]
    )
    texts.hint("rebalance", "category").write.mode(mode).partitionBy("category").json(f"{path}/entries")
    counts.write.mode(mode).json(f"{path}/categories")
    sections.write.mode(mode).json(f"{path}/instructions")
    return path


def as_json(df, name="json"):
    """One JSON text per row; types JSON lacks are written as text."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def preview(df, order, n=5):
    """First rows in a stated order."""
    return df.orderBy(*(order if isinstance(order, (list, tuple)) else [order])).limit(n)


def column_types(df):
    """Rows ``position, column, type``; reads no data."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
