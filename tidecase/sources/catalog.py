"""Tables by their names in the catalog, with statistics and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecase.sources.scratch import at_release, session_folder


class CatalogTables:
    """``CatalogTables(spark, "reports").orders`` is the table ``reports.orders``.

    Joins, broadcasts and shuffles are decided by the statistics of the tables, and tables bucketed alike join by their
    bucket key without a shuffle.
    """

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not self.spark.catalog.tableExists(f"{self.database}.{name}"):
            raise AttributeError(name)
        return self.spark.table(f"{self.database}.{name}")

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def add(self, df: DataFrame, name: str, bucket_by: list[str] | None = None, buckets: int = 0, path: str | None = None) -> None:
        """Store ``df`` as a table, one sorted file per bucket, and gather the statistics of all its columns; fails if the name is taken."""
        writer = df.write.format("parquet").mode("errorifexists").option("compression", "zstd")
        if bucket_by:
            buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer = df.repartition(buckets, *bucket_by).write.format("parquet").mode("errorifexists").option("compression", "zstd").bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(f"{self.database}.{name}")
        self.analyze(name)

    def analyze(self, name: str) -> None:
        self.spark.sql(f"ANALYZE TABLE {self.database}.{name} COMPUTE STATISTICS FOR ALL COLUMNS")


def catalog_of(spark: SparkSession, database: str, tables: dict[str, tuple[DataFrame, list[str] | None]], folder: str) -> CatalogTables:
    """A database with the given tables (frame, bucket columns), made where it is not there yet; files go under ``folder``."""
    if not spark.catalog.databaseExists(database):
        spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
        if folder.startswith(session_folder(spark)):
            at_release(spark, f"DROP DATABASE IF EXISTS {database} CASCADE")
    catalog = CatalogTables(spark, database)
    for name, (df, bucket_by) in tables.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            catalog.add(df, name, bucket_by, path=f"{folder}/{name}")
    return catalog
