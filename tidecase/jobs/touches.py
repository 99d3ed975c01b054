"""Who touched a case, in which role, and how often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.operators.bitmaps import distinct_rollup
from tidecase.operators.joins import with_group


def last_on_day(sessions: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Mark the last session of each key and day with 1, all others with 0.

    The last (ts, tie) per key and day is an aggregate with map-side combine; no group is sorted.
    """
    dated = sessions.withColumn("_day", F.to_date(ts))
    newest = F.max(F.struct(ts, tie)).alias("_newest")
    marked = with_group(dated, [*keys, "_day"], newest)
    is_last = F.struct(ts, tie) == F.col("_newest")
    return marked.withColumn("last_on_day", F.when(is_last, 1).otherwise(0)).select(*sessions.columns, "last_on_day")


def distinct_touches(sessions: DataFrame, case: str, worker: str, ts: str, seconds: Column, group: list[str]) -> DataFrame:
    """Touches, distinct touches (case, worker, day) and time per group.

    Rows are first reduced to one per case, worker and day: each such row is one distinct touch.
    """
    daily = sessions.groupBy(case, worker, F.to_date(ts).alias("_day"), *group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(seconds).alias("_s")
    )
    return daily.groupBy(case, *group).agg(
        F.sum("_n").alias("touches"), F.count(F.lit(1)).alias("distinct_touches"), F.sum("_s").alias("seconds")
    )


def touches_by_role(
    touched: DataFrame, case: str, role: str, roles: list[str], total: str = "Total", also: Sequence[Column] = ()
) -> DataFrame:
    """Distinct touches per case as one column per role plus the total over all roles, and ``also`` over all rows of a case.

    One aggregation per case; a role without touches is NULL.
    """
    n = F.col("distinct_touches")
    per_role = [F.sum(F.when(F.col(role) == r, n)).alias(r) for r in roles]
    return touched.groupBy(case).agg(*per_role, F.sum(n).alias(total), *also)


def team_summary(sessions: DataFrame, pilot: str, levels: list[list[str]]) -> DataFrame:
    """Cases, workers, distinct touches and time per case, and session length, with a subtotal per level.

    ``sessions``: case_id, worker, date_id, seconds, ``pilot`` and the level columns. Rows are reduced to one per case, worker and day, each of them one
    distinct touch; cases and workers are counted by bitmaps, which are merged level by level.
    """
    columns = [c for level in levels for c in level]
    daily = sessions.groupBy(pilot, *columns, "case_id", "worker", "date_id").agg(
        F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("touches")
    )
    added = {"_days": F.lit(1).cast("bigint"), "_seconds": F.col("seconds"), "_touches": F.col("touches")}
    sums = distinct_rollup(daily, [pilot], levels, {"cases": "case_id", "workers": "worker"}, added)
    return sums.select(
        pilot,
        *columns,
        "cases",
        "workers",
        (F.col("_days").cast("double") / F.col("cases")).alias("avg_touches"),
        (F.col("_seconds").cast("double") / F.lit(3600.0) / F.col("cases")).alias("avg_hours"),
        (F.col("_seconds").cast("double") / F.lit(60.0) / F.col("_touches")).alias("avg_session_minutes"),
    )
