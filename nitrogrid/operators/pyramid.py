"""Places below square cells of growing size, for descents that leave out what cannot matter.

A cell of one level holds 8 x 8 cells of the level below. Every cell that holds a place states the
tight extent of its places, so that a test against the extent decides for all of them.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

BITS = 3  # of a cell's numbers, from one level to the next


@dataclass
class Pyramid:
    """Written levels, smallest cells first, and the numbers of the cells above the last one, two each way at most."""

    levels: list
    rows: list
    columns: list

    def start(self, df):
        """Each row of ``df`` with every cell above the last level, as ``_pi, _pj``."""
        def numbers(found):
            return F.explode(F.array(*[F.lit(n).cast("long") for n in found]))

        return df.withColumn("_pi", numbers(self.rows)).withColumn("_pj", numbers(self.columns))


def numbered(places, smallest):
    """Places with ``_i, _j``, the numbers of their smallest cells."""
    return places.withColumns({name: F.floor(F.col(c) / F.lit(smallest)).cast("long") for name, c in (("_i", "_lat"), ("_j", "_lon"))})


def write_pyramid(places, path, smallest):
    """Write the levels over ``places`` (``_lat, _lon``) below ``path``; None without places.

    A level has ``_i, _j``, the cell above as ``_pi, _pj``, and the extent ``_lat_lo, _lat_hi, _lon_lo, _lon_hi``.
    Numbers are halved as integers, so a cell's parent is the same from every level.
    """
    spark = places.sparkSession
    extent = [f(c).alias(f"{c}_{n}") for c in ("_lat", "_lon") for n, f in (("lo", F.min), ("hi", F.max))]
    numbered(places, smallest).groupBy("_i", "_j").agg(*extent).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    i_lo, i_hi, j_lo, j_hi = cells.agg(F.min("_i"), F.max("_i"), F.min("_j"), F.max("_j")).first()
    if i_lo is None:
        return None
    roof = 1
    while (i_hi >> BITS * roof) - (i_lo >> BITS * roof) > 1 or (j_hi >> BITS * roof) - (j_lo >> BITS * roof) > 1:
        roof += 1
    up = {c: F.expr(f"shiftright({c}, _level * {BITS})") for c in ("_i", "_j")}
    again = [f(c).alias(c) for c, f in (("_lat_lo", F.min), ("_lat_hi", F.max), ("_lon_lo", F.min), ("_lon_hi", F.max))]
    if roof > 1:
        cells.withColumn("_level", F.explode(F.array(*map(F.lit, range(1, roof))))).withColumns(up) \
            .groupBy("_level", "_i", "_j").agg(*again).write.partitionBy("_level").parquet(f"{path}/above")
    # a folder for each level, so that its size is known to the joins
    levels = [cells, *[spark.read.parquet(f"{path}/above/_level={n}") for n in range(1, roof)]]
    above = {f"_p{n}": F.shiftright(f"_{n}", BITS) for n in ("i", "j")}
    return Pyramid(
        [level.withColumns(above) for level in levels],
        sorted({i_lo >> BITS * roof, i_hi >> BITS * roof}), sorted({j_lo >> BITS * roof, j_hi >> BITS * roof}))
