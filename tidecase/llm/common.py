"""Tables written between steps, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.sources.scratch import session_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder, which goes when the session ends."""
    return f"{session_path(spark, 'llm')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a key of its own for each row, and the key's name, which no column has."""
    key = f"row_{uuid.uuid4().hex}"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` for a task of a Python worker, which gives the memory that the task no longer needs back to the machine at its end."""

    def work(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            release_memory()

    return work


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, for work that makes much of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy_driver(spark: SparkSession) -> None:
    """Between long phases of a job: let the driver drop what is done with.

    Spark removes shuffle files and broadcasts of finished steps when the driver collects its garbage, which it seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release_memory()


def release_memory() -> None:
    """Give memory that Python has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by itself
        pass


_CACHE: dict[str, object] = {}


def worker_cache[T](owner: str, make: Callable[[], T]) -> T:
    """What a Python worker remembers between its tasks: one operator's at a time, so operators in a row don't add up in its memory."""
    if owner not in _CACHE:
        _CACHE.clear()
        _CACHE[owner] = make()
    return _CACHE[owner]


def forget() -> None:
    """Drop what this process remembers between tasks: the driver, which has none, need not keep it."""
    _CACHE.clear()
