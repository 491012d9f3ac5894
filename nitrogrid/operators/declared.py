"""Dense grids over declared axes: cells are integers, tiles are filled by position.

The axes are parameters, so nothing is collected and no frame of cells is joined. Each cell is
reduced to its last value first (combined before the shuffle, so a hot cell is cheap); then the
cells of a tile meet and are laid over its positions. A tile is one date and band of latitudes.
"""

from dataclasses import dataclass
import math

from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """``size`` values from ``low`` on, ``step`` apart."""

    low: float
    step: float
    size: int

    @classmethod
    def between(cls, low, high, step):
        """The axis that never passes ``high``."""
        return cls(low, step, math.floor((high - low) / step + 1e-9) + 1)

    def position(self, column):
        """Number of the cell that a coordinate lies in, from its lower edge on; null outside."""
        cell = F.floor((column - F.lit(self.low)) / F.lit(self.step))
        inside = (column >= F.lit(self.low)) & (column < F.lit(self.low + self.step * self.size)) & ~F.isnan(column)
        return F.when(inside & cell.between(0, self.size - 1), cell.cast("int"))

    def value(self, position):
        return F.lit(self.low) + position * F.lit(self.step)

    def values(self, first, count):
        """Array of ``count`` values from position ``first`` on."""
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: self.value(first + i))


def off_grid(df, lat_axis, lon_axis, lat="latitude", lon="longitude"):
    """Rows that no cell holds: a coordinate is missing or outside its axis."""
    return df.filter(lat_axis.position(F.col(lat)).isNull() | lon_axis.position(F.col(lon)).isNull())


def declared_tiles(df, lat_axis, lon_axis, value="no2", order="event_id", date="date", lat="latitude",
                   lon="longitude", rows_per_tile=64, absent=0.0):
    """One row per date that occurs and band of latitudes: ``date, lat_offset, values``.

    ``values`` has the cells of the band, latitude first; the row with the highest ``order`` gives
    a cell's value, and a cell without any row gets ``absent``. ``off_grid`` has the rows left out.
    """
    width = lon_axis.size
    placed = df.select(
        date, lat_axis.position(F.col(lat)).alias("_lat"), lon_axis.position(F.col(lon)).alias("_lon"),
        F.col(value).cast("double").alias("_value"), F.col(order).alias("_order"),
    ).filter("_lat IS NOT NULL AND _lon IS NOT NULL").select(
        date, F.floor(F.col("_lat") / F.lit(rows_per_tile)).cast("int").alias("_band"),
        (F.col("_lat") % rows_per_tile * width + F.col("_lon")).alias("_slot"), "_value", "_order",
    )
    cells = placed.groupBy(date, "_band", "_slot").agg(F.max_by("_value", "_order").alias("_value"))
    cell = F.struct(F.col("_slot").alias("slot"), F.lit(0).alias("blank"), F.col("_value").alias("v"))
    # every band of a date exists, also one without any cell
    bands = math.ceil(lat_axis.size / rows_per_tile)
    empty = df.select(date).distinct().select(
        date, F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("_band"), F.lit(None).cast(_type(cells, cell)).alias("_cell"))
    tiles = cells.select(date, "_band", cell.alias("_cell")).unionAll(empty).groupBy(date, "_band") \
        .agg(F.collect_list("_cell").alias("_cells"))
    rows = F.least(F.lit(rows_per_tile), F.lit(lat_axis.size) - F.col("_band") * rows_per_tile)
    # a blank cell at every position; after sorting it stands behind the observed one, if there is one
    blanks = F.transform(F.sequence(F.lit(0), rows * width - 1),
                         lambda i: F.struct(i.alias("slot"), F.lit(1).alias("blank"), F.lit(float(absent)).alias("v")))
    laid = tiles.select(date, "_band", rows.alias("_rows"), F.array_sort(F.concat("_cells", blanks)).alias("_laid"))
    first = F.filter("_laid", lambda c, i: (c["blank"] == 0) | (i == 0) | (F.get("_laid", i - 1)["slot"] != c["slot"]))
    return laid.select(
        date, (F.col("_band") * rows_per_tile).alias("lat_offset"), F.col("_rows").alias("lat_rows"),
        F.transform(first, lambda c: c["v"]).alias("values"),
    )


def _type(df, column):
    return df.select(column.alias("c")).schema["c"].dataType


def tile_cells(tiles, lat_axis, lon_axis, value="no2", date="date"):
    """The cells of tiles as rows: ``date, lat_index, lon_index, latitude, longitude, value``."""
    width = lon_axis.size
    rows = tiles.select(date, "lat_offset", F.posexplode("values").alias("_p", value))
    placed = rows.select(date, (F.col("lat_offset") + F.floor(F.col("_p") / width)).cast("int").alias("lat_index"),
                         (F.col("_p") % width).alias("lon_index"), value)
    return placed.select(date, "lat_index", "lon_index", lat_axis.value(F.col("lat_index")).alias("latitude"),
                         lon_axis.value(F.col("lon_index")).alias("longitude"), value)


def declared_blocks(tiles, lat_axis, lon_axis, date="date", attrs=None, ds_attrs=None):
    """Tiles as grid-block rows, with the axes written out."""
    def pairs(m):
        return F.create_map(*[F.lit(x) for p in m.items() for x in p]) if m else F.create_map().cast("map<string,string>")

    return tiles.select(
        F.concat(F.lit("grid_"), F.col(date).cast("date").cast("string")).alias("source_file"), "lat_offset",
        F.array(F.col(date).cast("timestamp_ntz")).alias("time"),
        lat_axis.values(F.col("lat_offset"), F.col("lat_rows")).alias("latitude"),
        lon_axis.values(F.lit(0), F.lit(lon_axis.size)).alias("longitude"),
        F.col("values").cast("array<float>").alias("no2"),
        pairs(attrs).alias("var_attrs"), pairs(ds_attrs).alias("ds_attrs"),
    )
