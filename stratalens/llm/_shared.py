"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_dir, ship  # noqa: F401  (ship: for the operators)

#: ASCII white space; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that a Python operator turns into Python strings at a time.
SLICE_ROWS = 256
#: The largest count of 8-byte ids that is sent to every executor.
BROADCAST_IDS = 500_000
#: Parquet's vectored reads, on by default, hold what they read in direct buffers that their threads keep, outside the heap.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def hash_bucket(col: Column | str, n: int, modulus: int) -> Column:
    """True for the rows with crc32(id as text) mod `modulus` = `n`; a null id counts as the empty text."""
    value = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(value.cast("string"), F.lit(""))) % modulus == n


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, with `options`: later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).options(**options).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df._scratch_path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries made and run in here have `key` set to `value`."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries made and run in here leave no shuffle files; else those stay until the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
