"""Readers with explicit schemas, so opening a table costs no schema-inference job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecase.sources.stages import StageStore

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """The tables of one directory as lazy DataFrames: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
        setattr(self, name, table)  # the files of a table are listed once
        return table

    @property
    def stages(self) -> StageStore:
        """Stages that several queries over these tables share."""
        return StageStore(self.spark)

    def views(self, *names: str) -> None:
        """Register temp views, for queries written in SQL."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)


def read_import(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A spreadsheet export (CSV with header) under a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def union_years(*yearly: DataFrame) -> DataFrame:
    """Per-year tables of one schema as one source; the filters of a query reach each branch."""
    result = yearly[0]
    for table in yearly[1:]:
        result = result.unionByName(table)
    return result
