"""Shared folder for tables written between steps, with an end of life."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_OPEN: dict[str, list[str]] = {}  # folder of a session: statements that take its tables out of the catalog


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where that setting is absent the warehouse folder takes its place, which driver and executors share as well.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for files that outlive the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def session_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared folder; it goes when the driver's JVM ends, or before by ``release_scratch``."""
    folder = f"{shared_folder(spark)}/tidecase-{spark.sparkContext.applicationId}"
    if folder not in _OPEN:
        files, place = file_system(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _OPEN[folder] = []
    return folder


def session_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's folder and read again: computed once, and safe when executors are lost."""
    path = session_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, by: list[str], sort: list[str | Column], dealt: bool = False) -> DataFrame:
    """``df`` stored with one sorted file per bucket of ``by``: windows and groups over ``by`` read it without a shuffle.

    ``dealt`` says that ``df`` comes from a join on ``by``, whose partitions hold whole buckets: it is not shuffled once more. Where the join
    turns out a broadcast, a bucket has several files, which costs a sort and no more.
    """
    spark = df.sparkSession
    folder, buckets = session_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidecase_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *by)
    rows.write.format("parquet").bucketBy(buckets, *by).sortBy(*sort).option("path", f"{folder}/{name}").saveAsTable(name)
    at_release(spark, f"DROP TABLE IF EXISTS {name}")
    return spark.table(name)


def at_release(spark: SparkSession, statement: str) -> None:
    """Run a statement when the session's folder is removed."""
    _OPEN[session_folder(spark)].append(statement)


def release_scratch(spark: SparkSession) -> None:
    """Remove all that the session has stored; results that read it must be written or collected by then."""
    folder = session_folder(spark)
    for statement in _OPEN.pop(folder):
        spark.sql(statement)
    files, place = file_system(spark, folder)
    files.delete(place, True)
