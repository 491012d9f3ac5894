"""Gridded sink: dense grid-block tiles as Parquet."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.operators.declared import declared_blocks, declared_tiles
from nitrogrid.operators.densify import dense_tiles

VARIABLE_ATTRS = {"long_name": "Nitrogen Dioxide Column", "units": K.UNITS}


def write_grid(df, path, title="Gridded NO2", rows_per_tile=64, mode="errorifexists", **columns):
    """Densify rows and write grid-block tiles with variable and dataset attributes."""
    tiles = dense_tiles(
        df, rows_per_tile=rows_per_tile, attrs=VARIABLE_ATTRS,
        ds_attrs={"title": title, "temporal_resolution": "daily"}, **columns,
    )
    stamped = tiles.withColumn("ds_attrs", F.map_concat(
        "ds_attrs", F.create_map(F.lit("created"), F.current_timestamp().cast("string"))
    ))
    stamped.write.mode(mode).parquet(path)
    return path


def write_declared_grid(df, path, lat_axis, lon_axis, title="Gridded NO2", date="date", **columns):
    """Write grid-block tiles over declared axes, one folder per day; days that are there already are replaced.

    Only the days of ``df`` are touched, so a run that is repeated, or follows with later days,
    leaves one version of each day. The tiles of a day go to one file of their own.
    """
    tiles = declared_tiles(df, lat_axis, lon_axis, date=date, **columns)
    blocks = declared_blocks(tiles, lat_axis, lon_axis, date, VARIABLE_ATTRS, {"title": title, "temporal_resolution": "daily"})
    day = F.col("time")[0].cast("date").alias("day")
    blocks.select("*", day).repartition("day").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return path
