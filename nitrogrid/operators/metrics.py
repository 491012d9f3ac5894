"""Regression metrics as plain aggregates."""

from pyspark.sql import functions as F

from nitrogrid.functions.classes import passes_gate, performance_level


def regression_metrics(df, label="label", prediction="prediction", by=()):
    """``n, r2, rmse, mae`` per group. R2 of a constant label is 1 if exact, else 0."""
    y, p = F.col(label), F.col(prediction)
    mse = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    r2 = F.when(spread > 0, 1 - mse / spread).otherwise(F.when(mse == 0, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        r2.alias("r2"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def with_verdict(metrics):
    """Add the performance level and the pass / fail gate to metric rows."""
    return metrics.withColumns({
        "level": performance_level(F.col("r2")),
        "passed": passes_gate(F.col("r2")),
    })
