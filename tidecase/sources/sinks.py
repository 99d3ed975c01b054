"""Writers: result tables and report files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_new_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet; fail when the target is there already."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed_table(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Save as a catalog table bucketed and sorted by ``keys``; fail when it exists.

    Tables bucketed alike join and group by these keys without a shuffle: worth it for a case master and
    its logs, which every job joins by case.
    """
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_report(df: DataFrame, path: str) -> None:
    """Write CSV with a header row, one file per task."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_results(results: dict[str, DataFrame], base: DataFrame, path: str) -> None:
    """Write a few report files that share ``base``, which is kept in memory meanwhile; ``write_result_sets`` needs one pass only."""
    base.persist()
    try:
        for name, df in results.items():
            write_report(df, f"{path}/{name}")
    finally:
        base.unpersist()


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Write the days that ``df`` has into a table kept by day, in place of what is there for them; other days stay.

    Doing it again changes nothing, so a run that failed half-way is simply repeated.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


@dataclass(frozen=True)
class ResultSet:
    """Rows of a base table for which ``where`` holds, with columns of their own and an order."""

    where: Column
    columns: dict[str, Column]
    order: Sequence[Column] = field(default_factory=tuple)


def result_rows(base: DataFrame, sets: dict[str, ResultSet]) -> DataFrame:
    """All result sets as rows of (``result``, every column of any set), from one pass over ``base``.

    A column that a set lacks is NULL in its rows; a name that several sets have must have one type.
    """
    kinds: dict[str, str] = {}
    for name, one in sets.items():
        for f in base.select(*[c.alias(n) for n, c in one.columns.items()]).schema:
            if kinds.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ValueError(f"column {f.name} of {name} is {f.dataType.simpleString()}, elsewhere {kinds[f.name]}")

    def entry(name: str, one: ResultSet) -> Column:
        own = [one.columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        return F.when(one.where, F.struct(F.lit(name).alias("result"), *own))

    listed = base.select(F.explode(F.array_compact(F.array(*[entry(n, one) for n, one in sets.items()]))).alias("_r"))
    return listed.select("_r.*")


def write_result_sets(base: DataFrame, sets: dict[str, ResultSet], path: str) -> StructType:
    """Write all result sets in one job, each in a folder of its own; returns the layout to read them by."""
    rows = result_rows(base, sets)
    rows.write.mode("errorifexists").partitionBy("result").parquet(path)
    return rows.drop("result").schema


def read_result(spark: SparkSession, path: str, name: str, one: ResultSet, layout: StructType) -> DataFrame:
    """One of the result sets that ``write_result_sets`` wrote, with its columns in its order."""
    rows = spark.read.schema(StructType([*layout.fields]).add("result", "string")).parquet(path).filter(F.col("result") == name)
    return rows.select(*one.columns).orderBy(*one.order) if one.order else rows.select(*one.columns)
