"""Worker-by-day dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import safe_ratio
from tidecase.operators.shapes import dense_grid, fill_grid
from tidecase.sources.sinks import replace_days


def productivity_grid(
    workers: DataFrame, first: Column, last: Column, facts: list[DataFrame], presence: DataFrame
) -> DataFrame:
    """Every worker on every day with the measures of each fact summary, all at (worker, day) grain.

    ``presence``: worker, day, logged_in, online (seconds). Measures stay NULL on days without rows.
    """
    grid = fill_grid(dense_grid(workers, first, last), [*facts, presence], ["worker", "day"])
    return grid.withColumn("online_rate", safe_ratio(F.col("online"), F.col("logged_in")))


def worker_days(log: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregate a log (worker, ts, …) to one row per worker and day."""
    return log.groupBy("worker", F.to_date("ts").alias("day")).agg(*aggs)


def dashboard(
    workers: DataFrame, as_of: Column, facts: list[DataFrame], presence: DataFrame, historical: bool, days: int = 120
) -> DataFrame:
    """The grid for the last ``days`` days, or only for the day of ``as_of``."""
    last = F.to_date(as_of)
    first = F.date_sub(last, days) if historical else last
    return productivity_grid(workers, first, last, facts, presence)


def call_cube(cube: DataFrame) -> DataFrame:
    """A cube's measures (seconds and counts by worker and day) summed to one row per worker and day."""
    measures = [c for c in cube.columns if c not in ("worker", "day")]
    return cube.groupBy("worker", "day").agg(*[F.sum(m).alias(m) for m in measures])


def both_cubes(calls: DataFrame, chats: DataFrame) -> DataFrame:
    """Talk and staff time over two cubes, the other measures of the first, times in days.

    ``calls``: worker, day, talk, staff, aux, avail, inbound, missed; ``chats``: worker, day, talk, staff. A worker who is in one of them only has
    the other's times as 0; the first's own measures stay NULL where it has no row.
    """
    second = call_cube(chats).select("worker", "day", F.col("talk").alias("_talk"), F.col("staff").alias("_staff"))
    joined = call_cube(calls).join(second, ["worker", "day"], "full")

    def days(*seconds: str) -> Column:
        total = F.coalesce(seconds[0], F.lit(0)) if len(seconds) > 1 else F.col(seconds[0])
        for s in seconds[1:]:
            total = total + F.coalesce(s, F.lit(0))
        return total / F.lit(86400.0)

    return joined.select(
        "worker", "day", days("talk", "_talk").alias("talk_time"), days("staff", "_staff").alias("staff_time"),
        days("aux").alias("aux_time"), days("avail").alias("avail_time"), F.col("inbound").alias("inbound_calls"), F.col("missed").alias("missed_calls"),
    )


def keep_dashboard(grid: DataFrame, path: str) -> None:
    """Put the days of ``grid`` into the kept grid under ``path``: all of the historical run, or today's in place of an earlier run's."""
    replace_days(grid, path, "day")
