"""The first of many boxes that holds a point, for tables of points and boxes of any length.

Boxes descend over the points' distinct places through cells of falling size (``pyramid``). A box
that holds the whole extent of a cell's places holds them all, and no box behind it counts there any
more; one that holds a part of the extent goes on to the cells below; an exact test with inclusive
edges comes last, where a cell's places are still partly held. So a place meets the boxes whose edges
pass close by and that come before all that hold its cell, not all boxes that hold it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from nitrogrid.operators.ordinals import with_ordinal
from nitrogrid.operators.pyramid import BITS, numbered, write_pyramid
from nitrogrid.session import work_path

SMALLEST = 0.125  # degrees
EDGES = ["lat_lo", "lat_hi", "lon_lo", "lon_hi"]


def _ranked(boxes, priority, take):
    """Sound boxes in their order: ``EDGES, _box, _n``; of boxes with the same edges the first.

    Boxes without extent or with null edges are not sound.
    """
    sound = boxes.filter("lat_lo <= lat_hi AND lon_lo <= lon_hi").select(*EDGES, F.struct(priority, *take).alias("_box"))
    return with_ordinal(sound.groupBy(*EDGES).agg(F.min("_box").alias("_box")), "_box", "_n")


def _first_of_places(places, ranked, pyramid, path, smallest):
    """Places with ``_n``, the number of the first box that holds each; null without one."""
    spark = places.sparkSession
    at = pyramid.start(ranked.select(*EDGES, "_n")).withColumn("_bound", F.lit(None).cast("long"))
    covers = []
    for level, cells in reversed(list(enumerate(pyramid.levels))):
        meets = ((F.col("lat_lo") <= F.col("_lat_hi")) & (F.col("lat_hi") >= F.col("_lat_lo"))
                 & (F.col("lon_lo") <= F.col("_lon_hi")) & (F.col("lon_hi") >= F.col("_lon_lo")))
        whole = ((F.col("lat_lo") <= F.col("_lat_lo")) & (F.col("lat_hi") >= F.col("_lat_hi"))
                 & (F.col("lon_lo") <= F.col("_lon_lo")) & (F.col("lon_hi") >= F.col("_lon_hi")))
        at.join(cells, ["_pi", "_pj"]).filter(meets).select(
            "_i", "_j", "_n", "_bound", whole.alias("_whole"), *[F.when(~whole, F.col(c)).alias(c) for c in EDGES],
        ).write.parquet(f"{path}/met-{level}")
        met = spark.read.parquet(f"{path}/met-{level}")
        cover = met.filter("_whole").groupBy("_i", "_j").agg(F.min("_n").alias("_cover"))
        covers.append((level, cover))
        bound = F.least("_bound", "_cover")
        at = met.filter("NOT _whole").join(cover, ["_i", "_j"], "left").filter(
            bound.isNull() | (F.col("_n") < bound)).select(
            *EDGES, "_n", bound.alias("_bound"), F.col("_i").alias("_pi"), F.col("_j").alias("_pj"))
    placed = numbered(places, smallest)
    part = at.join(placed, (F.col("_pi") == F.col("_i")) & (F.col("_pj") == F.col("_j"))).filter(
        F.col("_lat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("_lon").between(F.col("lon_lo"), F.col("lon_hi")))
    best = placed.join(part.groupBy("_lat", "_lon").agg(F.min("_n").alias("_part")), ["_lat", "_lon"], "left")
    for level, cover in covers:
        names = {"_i": f"_i{level}", "_j": f"_j{level}", "_cover": f"_cover{level}"}
        best = best.join(cover.withColumnsRenamed(names), (
            (F.shiftright("_i", BITS * level) == F.col(f"_i{level}")) & (F.shiftright("_j", BITS * level) == F.col(f"_j{level}"))), "left")
    return best.select("_lat", "_lon", F.least("_part", *[f"_cover{level}" for level, _ in covers]).alias("_n"))


def first_box(points, boxes, key, priority="priority", take=("weight",), lat="latitude", lon="longitude",
              smallest=SMALLEST):
    """Columns ``take`` and ``priority`` of the first box, by priority, that holds each point; null without one.

    boxes: ``lat_lo, lat_hi, lon_lo, lon_hi``, a priority that orders them, and the columns to take.
    ``key`` names the points; those that share one share the first of their boxes, and one without a key
    has none. A point with a null or NaN coordinate lies in no box.
    """
    path = work_path(points.sparkSession, "boxes")
    # zero is added so that both zeros are one place
    where = {"_lat": F.col(lat) + F.lit(0.0), "_lon": F.col(lon) + F.lit(0.0)}
    points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).select(
        *[c.alias(name) for name, c in where.items()]).distinct().write.parquet(f"{path}/places")
    places = points.sparkSession.read.parquet(f"{path}/places")
    ranked = _ranked(boxes, priority, take)
    pyramid = None if ranked.isEmpty() else write_pyramid(places, path, smallest)
    if pyramid is None:
        return points.select("*", *[F.lit(None).cast(boxes.schema[c].dataType).alias(c) for c in (priority, *take)])
    first = _first_of_places(places, ranked, pyramid, path, smallest)
    first.join(ranked.select("_n", "_box"), "_n").select("_lat", "_lon", "_box").write.parquet(f"{path}/first")
    best = points.sparkSession.read.parquet(f"{path}/first")
    # points without a key are dealt by place: they would be one group
    mine = Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(*where.values())))
    found = F.when(F.col(key).isNotNull(), F.min("_box").over(mine))
    return points.join(best, (where["_lat"] == F.col("_lat")) & (where["_lon"] == F.col("_lon")), "left").select(
        points["*"], *[found[c].alias(c) for c in (priority, *take)])
