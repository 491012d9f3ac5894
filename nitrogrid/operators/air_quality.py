"""Air-quality class of each row, and the class dimension."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.classes import air_quality_code, air_quality_colour, air_quality_text


def classify(df, value="no2_value"):
    x = F.col(value)
    return df.withColumns({
        "air_quality": air_quality_code(x),
        "air_quality_text": air_quality_text(x),
        "color": air_quality_colour(x),
    })


def class_dimension(spark):
    """Four rows: code, display name, display colour, emoji."""
    rows = ", ".join(
        "(" + ", ".join(f"'{v}'" for v in row) + ")" for row in K.AIR_QUALITY_DIMENSION
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS d(air_quality, display_name, display_colour, emoji)"
    )


def with_display(df, fallback_text="air_quality_text"):
    """Display columns of each row's class; unknown codes keep the given text."""
    dimension = F.broadcast(class_dimension(df.sparkSession))  # always four rows
    return df.join(dimension, "air_quality", "left").withColumns({
        "display_name": F.coalesce("display_name", fallback_text),
        "display_colour": F.coalesce("display_colour", F.lit(K.UNKNOWN_COLOUR)),
        "emoji": F.coalesce("emoji", F.lit(K.UNKNOWN_EMOJI)),
    })
