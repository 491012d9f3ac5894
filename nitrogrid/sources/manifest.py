"""Product manifests: discovery and CSV scans."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitrogrid import constants as K
from nitrogrid.functions.text import contains_any, na_to_null
from nitrogrid.sources.files import list_files


def manifest_in(listing, keywords=None):
    """One row ``path``: the first CSV file by name whose name mentions a keyword."""
    keywords = K.MANIFEST_NAME_KEYWORDS if keywords is None else keywords
    named = F.col("file_name").endswith(".csv") & contains_any(F.lower("file_name"), keywords)
    chosen = listing.filter(named).agg(F.min_by("path", "file_name").alias("path"))
    return chosen.filter("path IS NOT NULL")


def find_manifest(spark, folder, keywords=None):
    return manifest_in(list_files(spark, folder, "*.csv"), keywords)


def read_manifest_texts(spark, path, schema=None, multi_line=True):
    """All cells as text, in file order.

    Cells may hold quoted line breaks, so a file is one split. A manifest without them can be read
    with ``multi_line=False``, in as many splits as its size asks for.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_manifest(spark, path, types=None, tokens=None):
    """Cells with missing-value texts as null and inferred (or given) types."""
    texts = read_manifest_texts(spark, path)
    clean = texts.select(*[
        na_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in texts.columns
    ])
    types = infer_types(clean) if types is None else types
    return clean.select(*[
        F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in clean.columns
    ])


# texts that read as a number; the long form is checked by a cast as well
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"
BOOLEAN = r"^([tT]rue|TRUE|[fF]alse|FALSE)$"


def infer_types(texts):
    """Column -> the narrowest of bigint, double, boolean, string that holds every cell.

    One aggregate over the table, like the reader's own inference, but after the
    missing-value texts are gone.
    """
    checks = []
    for i, c in enumerate(texts.columns):
        cell = F.col(f"`{c}`")
        fits = {
            "bigint": cell.rlike(INTEGER) & F.when(cell.rlike(INTEGER), cell).try_cast("bigint").isNotNull(),
            "double": cell.rlike(NUMBER),
            "boolean": cell.rlike(BOOLEAN),
        }
        checks.append(F.count(cell).alias(f"n{i}"))
        checks += [F.count_if(test).alias(f"{kind}{i}") for kind, test in fits.items()]
    row = texts.agg(*checks).first()
    found = {}
    for i, c in enumerate(texts.columns):
        n = row[f"n{i}"]
        found[c] = next(
            (k for k in ("bigint", "double", "boolean") if n and row[f"{k}{i}"] == n), "string"
        )
    return found


def with_row_number(df, name="row_number", first=2, per_file=True):
    """Ordinal of each record in its file, counted from ``first`` (the header is line 1).

    Only for a frame read straight from files. A split of a file is read by one task in
    order, so a row's place is its place in the split plus the records of earlier splits.
    ``per_file=False`` counts on through the files in path order.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = placed.groupBy("_file", "_split").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # one row per file split, as many as the scan has input splits
    scope = Window.partitionBy("_file") if per_file else Window.partitionBy()
    earlier = scope.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        F.col("_file").alias("_f"), F.col("_split").alias("_s"), "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))
    return placed.join(offsets, same).withColumn(
        name, F.col("_id") - F.col("_first") + F.col("_offset") + F.lit(first)
    ).select(*df.columns, name)


def texts_schema(columns):
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
