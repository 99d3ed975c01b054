"""Stored daily snapshots: one partition per day, appended a day at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.sources.sinks import replace_days


class SnapshotStore:
    """Snapshots of one kind under ``path``, partitioned by their whole-number date id ``day``.

    ``of``: the snapshot of a source, with the day's column, for all days or for one day id; for one it should read that day only.
    """

    def __init__(self, spark: SparkSession, path: str, of: Callable[[int | None], DataFrame], day: str = "snapshot_id"):
        self.spark, self.path, self.of, self.day = spark, path, of, day

    def rebuild(self) -> None:
        """Write all days of the source in one job, a day's rows in few files."""
        replace_days(self.of(None).repartition(self.day, F.pmod(F.xxhash64(*self._columns()), F.lit(8))), self.path, self.day)

    def append(self, day_id: int) -> None:
        """Add one day, or put a new version of it in place of the old one; other days are not touched."""
        replace_days(self.of(day_id), self.path, self.day)

    def read(self) -> DataFrame:
        """All days; a filter or a join on the day reads the partitions that it needs."""
        return self.spark.read.schema(self.of(None).schema).parquet(self.path)

    def on(self, days: DataFrame, date_id: str) -> DataFrame:
        """Snapshots of the days that a dimension lists, found while the query runs: partitions of other days are not read."""
        listed = F.broadcast(days.select(F.col(date_id).alias(self.day)).distinct())  # one row per date of a calendar
        return self.read().join(listed, self.day)

    def _columns(self) -> list[str]:
        return [c for c in self.of(None).columns if c != self.day]
