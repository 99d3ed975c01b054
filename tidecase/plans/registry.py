"""Registry of named queries, each with the SQL a second engine can check it against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from tidecase.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(Tables(spark, path))

        QUERIES[name] = Query(name, run, dedent(sql).strip() if sql else None)
        return fn

    return register
