"""Feature scaling with statistics of the training part only."""

from pyspark.sql import functions as F

KINDS = ("standard", "minmax")


def check_kind(kind):
    if kind not in KINDS:
        raise ValueError("kind must be 'standard' or 'minmax'")


def scaler_statistics(df, columns, kind="standard"):
    """One row; per column a struct ``shift, scale`` with scaled = (x - shift) / scale.

    A constant column gets scale 1, so it becomes 0.
    """
    check_kind(kind)
    fits = []
    for c in columns:
        x = F.col(c).cast("double")
        if kind == "standard":
            # the running deviation of equal values is exactly 0
            shift, spread = F.avg(x), F.stddev_pop(x)
        else:
            shift, spread = F.min(x), F.max(x) - F.min(x)
        fits.append(F.struct(
            shift.alias("shift"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"),
        ).alias(c))
    return df.agg(*fits)


def scale_features(df, columns, kind="standard", fit_on="train", prefix=""):
    """Scale every row with statistics fitted on the rows of split ``fit_on``.

    The statistics are one row and reach the tasks as a scalar subquery. ``fit_on=None``
    fits on all rows.
    """
    check_kind(kind)
    training = df if fit_on is None else df.filter(F.col("split") == fit_on)
    fitted = scaler_statistics(training, columns, kind).select(F.struct("*")).scalar()
    # one column that holds the row, so that the subquery is planned once
    return df.withColumn("_fit", fitted).withColumns({
        f"{prefix}{c}": (F.col(c).cast("double") - F.col("_fit")[c]["shift"]) / F.col("_fit")[c]["scale"]
        for c in columns
    }).drop("_fit")
