"""Dense grids from observation rows, the inverse of flattening.

Each cell is reduced to its last value first (map-side combined, so a hot cell is cheap). The
frame of all cells is made by exploding coordinate arrays, not by a cross join. Coordinate
arrays are the axes of the grid and part of every block, so they fit in a row by definition;
snap free coordinates to a regular axis first.
"""

from pyspark.sql import functions as F

from nitrogrid.operators.partitioning import spread


def snap(df, lat="latitude", lon="longitude", step=1.0):
    """Move coordinates down to a regular axis."""
    return df.withColumns({
        c: F.floor(F.col(c) / F.lit(step)) * F.lit(step) for c in (lat, lon)
    })


def axis(df, column):
    """Scalar column: the sorted distinct values of a coordinate."""
    values = df.select(column).distinct()
    return values.select(F.sort_array(F.collect_list(column))).scalar()


def last_values(df, keys, value, order):
    """One value per cell; the row with the highest ``order`` wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def grid_frame(df, date="date", lat="latitude", lon="longitude"):
    """All cells: each date x each latitude x each longitude that occurs, with positions."""
    dates = df.select(date).distinct()
    rows = spread(dates.select(date, F.posexplode(axis(df, lat)).alias("lat_index", lat)), date, lat)
    return rows.select(date, "lat_index", lat, F.posexplode(axis(df, lon)).alias("lon_index", lon))


def densify(df, value="no2", order="event_id", date="date", lat="latitude", lon="longitude",
            absent=0.0):
    """Every cell of the grid as a row; a cell without observation gets ``absent``."""
    keys = [date, lat, lon]
    cells = last_values(df, keys, value, order).withColumn("_seen", F.lit(True))
    return grid_frame(df, *keys).join(cells, keys, "left").select(
        *keys, "lat_index", "lon_index",
        F.when(F.col("_seen"), F.col(value)).otherwise(F.lit(absent)).alias(value),
    )


def dense_tiles(df, value="no2", order="event_id", date="date", lat="latitude", lon="longitude",
                rows_per_tile=64, absent=0.0, attrs=None, ds_attrs=None):
    """Grid-block rows, one per date and band of latitudes.

    Observed cells and the frame meet in one shuffle on (date, band): the cell aggregate and
    both array aggregates use that partitioning. A band holds at most
    ``rows_per_tile * number of longitudes`` cells.
    """
    lat_axis, lon_axis = axis(df, lat), axis(df, lon)
    band = F.floor(F.col("lat_index") / F.lit(rows_per_tile)).cast("int").alias("band")
    # one row per latitude of the grid
    bands = df.sparkSession.range(1).select(F.posexplode(lat_axis).alias("lat_index", "_lat"))
    frame = grid_frame(df, date, lat, lon).select(
        date, band, lat, lon, F.lit(None).cast("double").alias(value), F.lit(False).alias("seen"),
    )
    cells = last_values(df, [date, lat, lon], value, order)
    placed = cells.join(bands, F.col(lat) == F.col("_lat")).select(
        date, band, lat, lon, F.col(value).cast("double").alias(value), F.lit(True).alias("seen"),
    )
    full = frame.unionAll(placed).repartition(date, "band").groupBy(date, "band", lat, lon).agg(
        F.max("seen").alias("seen"), F.max(value).alias(value)
    )
    filled = F.when(F.col("seen"), F.col(value)).otherwise(F.lit(absent))
    # rows of a band first, then the band: short sorts instead of one long one
    rows = full.groupBy(date, "band", lat).agg(
        F.array_sort(F.collect_list(F.struct(lon, filled.cast("float").alias("v")))).alias("cells")
    ).select(date, "band", lat, F.transform("cells", lambda c: c["v"]).alias("row"))
    tiles = rows.groupBy(date, "band").agg(
        F.array_sort(F.collect_list(F.struct(lat, "row"))).alias("rows")
    )
    return tiles.select(
        F.concat(F.lit("grid_"), F.col(date).cast("date").cast("string")).alias("source_file"),
        (F.col("band") * rows_per_tile).alias("lat_offset"),
        F.array(F.col(date).cast("timestamp_ntz")).alias("time"),
        F.transform("rows", lambda r: r[lat]).alias("latitude"),
        lon_axis.alias("longitude"),
        F.flatten(F.transform("rows", lambda r: r["row"])).alias("no2"),
        _literal_map(attrs).alias("var_attrs"),
        _literal_map(ds_attrs).alias("ds_attrs"),
    )


def _literal_map(pairs):
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def rows_to_blocks(rows, key, value="no2", position="position"):
    """Arrays of values per block from rows that carry their position in the block."""
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    return rows.groupBy(key).agg(F.transform(ordered, lambda c: c[value]).alias(value))
