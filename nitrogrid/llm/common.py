"""Small helpers of the text operators: reading, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrogrid.session import work_path  # noqa: F401  (also for tests)

ROWS_PER_BATCH = 2_000
BYTES_PER_BATCH = 8 << 20
BYTES_PER_SMALL_BATCH = 2 << 20
SPACE_CLASS = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that tasks can import it.

    Texts can be long, so the session's Arrow batches are set to fewer rows than Spark's default and
    to a number of bytes; smaller settings of the caller stay.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    bound_batches(spark, BYTES_PER_BATCH)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in package.rglob("*.py"):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession, most_bytes: int) -> None:
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not (most.isdigit() and 0 < int(most) <= most_bytes):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def small_batches(spark: SparkSession) -> None:
    """For several operators in one session: what each of them leaves in executors and workers adds up."""
    bound_batches(spark, BYTES_PER_SMALL_BATCH)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; every other column is left aside, whatever its name."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def with_text_key(rows: DataFrame) -> DataFrame:
    """id_and_text with a hash of the text: rows of one doc_id that hold different texts are told apart."""
    return id_and_text(rows).withColumn("text_key", F.xxhash64("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(function):
    """A function over batches that gives unused memory back to the system once its task has ended.

    Workers live on and serve later stages; without this each keeps what its largest batch took.
    """
    @wraps(function)
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of the texts in it (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return raw[base:int(offsets[-1])], offsets - base


def pieces_of(batch: pa.RecordBatch, most_bytes: int, text: str = "text"):
    """Slices of a batch whose texts have most_bytes together, or that hold one text."""
    lengths = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parquet_rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()
