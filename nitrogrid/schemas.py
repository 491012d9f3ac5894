"""Explicit schemas at the engine's boundaries."""

from pyspark.sql import types as T

GRID_BLOCK = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("time", T.ArrayType(T.TimestampNTZType())),
    T.StructField("latitude", T.ArrayType(T.DoubleType())),
    T.StructField("longitude", T.ArrayType(T.DoubleType())),
    # flat values in row-major (time, latitude, longitude) order
    T.StructField("no2", T.ArrayType(T.FloatType())),
    T.StructField("var_attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ds_attrs", T.MapType(T.StringType(), T.StringType())),
])

OBSERVATION = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("file_index", T.LongType()),
    T.StructField("no2", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("time", T.TimestampNTZType()),
])

COVARIATES = [
    T.StructField("month", T.IntegerType()),
    T.StructField("day_of_year", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
]

SCORE_REQUEST = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("name", T.StringType()),
    *COVARIATES,
])

BATCH_REQUEST = T.StructType([
    T.StructField("locations", T.ArrayType(T.StructType([
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("name", T.StringType()),
    ]))),
    *COVARIATES,
])
