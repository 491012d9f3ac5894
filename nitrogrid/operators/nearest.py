"""The nearest observation of each place, for tables of places and observations of any length.

Places and observations meet by square cell, an equi-join: a place looks into its own cell and the
eight around it. What it finds is the nearest once it is nearer than the edge of these nine cells,
as whatever lies outside is at least as far as the edge. Places without such a proof descend through
cells of falling size (``pyramid``): of the cells at hand a place keeps those whose extent may hold
what is nearest. So a place far from all observations meets the few at the near edge, not all of them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from nitrogrid.operators.pyramid import numbered, write_pyramid
from nitrogrid.session import work_path

SMALLEST = 0.125  # degrees; a power of two, so that cell borders are exact
LARGEST = 360.0   # degrees
SITES = 64        # observed places in one row, at most


def _present(lat, lon):
    return lat.between(-LARGEST, LARGEST) & lon.between(-LARGEST, LARGEST)


def nearest(points, observations, tie, take, lat="latitude", lon="longitude", distance="distance",
            smallest=SMALLEST):
    """Add the columns ``take`` of the nearest observation and its planar ``distance`` in degrees.

    Of observations at one distance the one with the smallest ``tie`` is taken. Both frames name
    their coordinates ``lat`` and ``lon``. A point or an observation with a null or NaN coordinate, or
    one beyond 360 degrees, is no place: such a point gets nulls, and so do all where there is no
    observation. Null ties come first.

    Observations are first reduced to one row per exact place, combined before the shuffle, and
    points to distinct places, so neither many rows at one place nor many equal points weigh on the
    join. ``smallest`` is the size of the first cells: it should suit the distance that is usual
    between a point and its nearest observation.
    """
    spark = points.sparkSession
    # zero is added so that both zeros are one place
    where = [(F.col(lat) + F.lit(0.0)).alias("_lat"), (F.col(lon) + F.lit(0.0)).alias("_lon")]
    fields = [F.col(tie).alias("_tie"), *[F.col(c).alias(f"_take_{c}") for c in take]]
    path = work_path(spark, "nearest")
    observations.filter(_present(F.col(lat), F.col(lon))).select(*where, F.struct(*fields).alias("_row")) \
        .groupBy("_lat", "_lon").agg(F.min_by("_row", "_row._tie").alias("_row")).write.parquet(f"{path}/sites")
    points.filter(_present(F.col(lat), F.col(lon))).select(*where).distinct().write.parquet(f"{path}/places")
    sites, places = spark.read.parquet(f"{path}/sites"), spark.read.parquet(f"{path}/places")
    _look(places, sites, smallest).write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    every, still = near.filter("_proved").select("_lat", "_lon", "_best"), near.filter("NOT _proved")
    pyramid = None if still.isEmpty() else write_pyramid(sites.select("_lat", "_lon"), path, smallest)
    if pyramid:
        _descend(still, sites, pyramid, smallest).write.parquet(f"{path}/far")
        every = every.unionByName(spark.read.parquet(f"{path}/far"))
    here = (F.col(lat) + F.lit(0.0) == F.col("_lat")) & (F.col(lon) + F.lit(0.0) == F.col("_lon"))
    return points.join(every, here, "left").select(
        points["*"], *[F.col(f"_best._row._take_{c}").alias(c) for c in take], F.sqrt("_best._d2").alias(distance))


def _squared(lat, lon):
    """Squared distance of the place ``_lat, _lon``."""
    dy, dx = lat - F.col("_lat"), lon - F.col("_lon")
    return dy * dy + dx * dx


def _look(places, sites, size):
    """Places with the best site of nine cells, and whether it is proved to be the nearest.

    Sites go to the nine cells from which they are seen and stand there in rows of ``SITES`` at most, so
    a place meets few rows, in its own cell's task.
    """
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    seen = numbered(sites, size).withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps)).select(
        (F.col("_i") + F.col("_di")).alias("_i"), (F.col("_j") + F.col("_dj")).alias("_j"),
        F.struct("_lat", "_lon", "_row").alias("_site"))
    place = F.row_number().over(Window.partitionBy("_i", "_j").orderBy("_site._lat", "_site._lon"))
    rows = seen.withColumn("_part", F.floor((place - 1) / F.lit(SITES))).groupBy("_i", "_j", "_part").agg(
        F.collect_list("_site").alias("_sites")).drop("_part")
    first = F.array_min(F.transform("_sites", lambda s, n: F.struct(
        _squared(s["_lat"], s["_lon"]).alias("_d2"), s["_row"]["_tie"].alias("_tie"), n.alias("_n"))))
    met = numbered(places, size).join(rows, ["_i", "_j"], "left").withColumn("_first", first)
    best = F.when(F.col("_sites").isNotNull(), F.struct(
        "_first._d2", "_first._tie", F.get("_sites", F.col("_first._n"))["_row"].alias("_row")))
    joined = met.select("_i", "_j", "_lat", "_lon", best.alias("_best")).groupBy("_i", "_j", "_lat", "_lon").agg(
        F.min_by("_best", F.struct("_best._d2", "_best._tie")).alias("_best"))

    def edge(value, number):
        below = value - (number - F.lit(1)) * F.lit(size)
        return F.least(below, (number + F.lit(2)) * F.lit(size) - value)

    border = F.least(edge(F.col("_lat"), F.col("_i")), edge(F.col("_lon"), F.col("_j")))
    # strictly: a site outside that is as far as the edge might win by its tie
    proved = F.coalesce(F.col("_best._d2") < border * border, F.lit(False))
    return joined.select("_lat", "_lon", "_best", proved.alias("_proved"))


def _descend(places, sites, pyramid, smallest):
    """Places with the best of all sites.

    No site of a cell is nearer than the cell's extent, and as each side of the extent touches a site,
    one is as near as the far end of some side. Cells beyond the least such end are left out. Both are
    computed as the distances of the sites are, by steps that keep the order of numbers, so rounding
    leaves out no site that counts, and none of several at one distance.
    """
    at = pyramid.start(places.select(
        "_lat", "_lon", F.coalesce("_best._d2", F.lit(float("inf"))).alias("_bound")))
    mine = Window.partitionBy("_lat", "_lon")
    for cells in reversed(pyramid.levels):
        at = at.join(cells, ["_pi", "_pj"]).withColumns(_reach()).filter("_low <= _bound")
        at = at.withColumn("_bound", F.least("_bound", F.min("_high").over(mine))).filter("_low <= _bound").select(
            "_lat", "_lon", "_bound", F.col("_i").alias("_pi"), F.col("_j").alias("_pj"))
    there = numbered(sites, smallest).select(
        F.col("_i").alias("_pi"), F.col("_j").alias("_pj"), F.struct("_lat", "_lon", "_row").alias("_site"))
    met = at.join(there, ["_pi", "_pj"]).select("_lat", "_lon", "_bound", F.struct(
        _squared(F.col("_site._lat"), F.col("_site._lon")).alias("_d2"), F.col("_site._row._tie").alias("_tie"),
        F.col("_site._row").alias("_row")).alias("_best")).filter("_best._d2 <= _bound")
    return met.groupBy("_lat", "_lon").agg(F.min_by("_best", F.struct("_best._d2", "_best._tie")).alias("_best"))


def _reach():
    """Squared distances that no site of a cell is nearer than (``_low``), and that one site at least is as near as."""
    def sides(c):
        low, high = F.col(f"{c}_lo") - F.col(c), F.col(f"{c}_hi") - F.col(c)
        near, far = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
        return F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(near), near, far

    (y0, y1, y2), (x0, x1, x2) = sides("_lat"), sides("_lon")
    return {"_low": y0 * y0 + x0 * x0, "_high": F.least(y1 * y1 + x2 * x2, y2 * y2 + x1 * x1)}
