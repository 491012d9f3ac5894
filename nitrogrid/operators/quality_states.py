"""Data-quality states per file that merge into a report without reading rows again.

A state is one row per file: counts, mean and squared deviations, extremes, and two sketches of
bounded size. States of new files are appended, states of removed files are left out, and a report
over any set of files is a merge of its states. All but the distinct times and the median are exact.
"""

from pyspark.sql import functions as F

from nitrogrid.operators.missing import missing_cells
from nitrogrid.operators.quality import _valid

# sketch sizes: relative error of distinct counts about 1.6 % (2^12 registers), rank error about 0.8 %
LOG_REGISTERS = 12
RANKS = 400
# two-sided bounds that a report keeps with high probability
DISTINCT_BOUND = 0.065
RANK_BOUND = 0.02


def quality_states(df, by="source_file", value="no2", lat="latitude", lon="longitude", time="time",
                   registers=LOG_REGISTERS, ranks=RANKS):
    """One state per value of ``by`` (null is a file of its own).

    One aggregate, combined before the shuffle, so a file that holds most of the rows is cheap.
    """
    x = _valid(value)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum(missing_cells(df)), F.lit(0)).alias("missing_values"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.min(_valid(lat)).alias("lat_min"),
        F.max(_valid(lat)).alias("lat_max"),
        F.min(_valid(lon)).alias("lon_min"),
        F.max(_valid(lon)).alias("lon_max"),
        F.min(time).alias("time_min"),
        F.max(time).alias("time_max"),
        # times enter by their microseconds: sketches take numbers and texts
        F.hll_sketch_agg(F.unix_micros(F.col(time).cast("timestamp")), F.lit(registers)).alias("times"),
        F.kll_sketch_agg_double(x, F.lit(ranks)).alias("values"),
    )


def without_files(states, gone, by="source_file"):
    """The states but for those of removed files (``gone``: a frame with the column ``by``)."""
    names = gone.select(F.col(by).alias("_gone"))
    return states.join(names, F.col(by).eqNullSafe(F.col("_gone")), "left_anti")


def replace_states(states, newer, by="source_file"):
    """States after some files were added or written anew: a newer state takes an older one's place."""
    return without_files(states, newer, by).unionByName(newer)


def merged_report(states):
    """The columns of ``quality_report`` from states; one row, also without states.

    Squared deviations are merged around the common mean, which comes first, from the states:
    nothing is cancelled by large means.
    """
    centre = states.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    off = F.col("mean") - centre
    n = F.sum("n")
    spread = F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * off * off))
    merged = states.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_samples", "missing_values")],
        (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"),
        *[F.min(c).alias(c) for c in ("min", "lat_min", "lon_min", "time_min")],
        *[F.max(c).alias(c) for c in ("max", "lat_max", "lon_max", "time_max")],
        F.hll_union_agg("times").alias("_times"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("values"))).alias("_values"),
        n.alias("_n"),
    )
    return merged.withColumns({
        "unique_times": F.coalesce(F.hll_sketch_estimate("_times"), F.lit(0)),
        "median": F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_values", F.lit(0.5))),
    }).drop("_times", "_values", "_n")
