"""Pipeline size, pull-through, aged backlog, historical comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecase.functions.measures import count_if, safe_ratio
from tidecase.functions.timeid import datediff_boundary, from_dateid
from tidecase.operators.events import nth_event
from tidecase.operators.intervals import state_on
from tidecase.operators.shapes import dense_grid


def pipeline_size(versions: DataFrame, first: Column, last: Column) -> DataFrame:
    """Cases per state and day from day-grain versions (state, start_id, end_id).

    Counted as entries minus exits, accumulated over days: work and rows follow the number of changes, not
    cases times days. Changes before ``first`` make up its opening balance. Versions are read once, for the changes, which know the states too
    (one whose changes all come after ``last`` has them without a day); the accumulating window runs over one row per state and day.
    """
    entry = F.struct(from_dateid("start_id").alias("day"), F.lit(1).alias("change"))
    leave = F.struct(F.date_add(from_dateid("end_id"), 1).alias("day"), F.lit(-1).alias("change"))
    changes = (
        versions.select("state", F.explode(F.array(entry, leave)).alias("c"))
        .groupBy("state", F.when(F.col("c.day") <= last, F.greatest("c.day", first)).alias("day"))
        .agg(F.sum("c.change").alias("change"))
    )
    grid = dense_grid(changes.select("state").distinct(), first, last)
    so_far = Window.partitionBy("state").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        grid.join(changes, ["state", "day"], "left")
        .withColumn("cases", F.sum(F.coalesce("change", F.lit(0))).over(so_far))
        .select("state", "day", "cases")
    )


def pull_through(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed and fallen-out cases and the closed share, per month of the event that ended the case.

    ``cases``: closed_at and fallout_at (at most one set) plus ``keys``.
    """
    ended = F.coalesce("closed_at", "fallout_at")
    month = (F.year(ended) * 100 + F.month(ended)).alias("month_key")
    counted = (
        cases.filter(ended.isNotNull())
        .groupBy(month, *keys)
        .agg(F.count("closed_at").alias("closed"), F.count("fallout_at").alias("fallout"))
    )
    return counted.withColumn("pull_through", safe_ratio(F.col("closed"), F.col("closed") + F.col("fallout")))


def aged_backlog(
    cases: DataFrame, items: DataFrame, as_of: Column, min_days: int, hold: str, exclude_status: str
) -> DataFrame:
    """Open cases older than ``min_days``: age, number of holds, and date of the fourth hold.

    ``cases``: case_id, status, opened, closed. ``items``: case_id, ts, status and a unique ``tie`` struct.
    """
    holds = items.filter(F.col("status") == hold)
    counts = holds.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("holds"), F.max("ts").alias("last_hold")
    )
    fourth = nth_event(holds, ["case_id"], ["ts", "tie"], 4).select("case_id", F.col("ts").alias("fourth_hold"))
    open_cases = cases.filter(
        ~F.col("status").eqNullSafe(exclude_status)
        & (F.col("closed") == 0)
        & (datediff_boundary("DAY", F.col("opened"), as_of) >= min_days)
    )
    return (
        open_cases.join(counts, "case_id", "left")
        .join(fourth, "case_id", "left")
        .withColumn("age_days", datediff_boundary("DAY", F.col("opened"), as_of))
        .fillna(0, ["holds"])
        .select("case_id", "status", "age_days", "holds", "last_hold", "fourth_hold")
    )


def cohort_compare(
    cases: DataFrame, snapshot: DataFrame, age_days: int, states: Sequence[str], compare_id: int, compare: DataFrame | None = None
) -> DataFrame:
    """Cases exactly ``age_days`` old on a snapshot day, with their state on the comparison day.

    ``cases``: case_id, opened, closed_at, fallout_at. ``snapshot``: case_id, snapshot_id, state. ``compare``: the snapshot of the
    comparison day alone, where a source can read that day by itself.
    """
    day = from_dateid("snapshot_id")
    compare_day = from_dateid(F.lit(compare_id))
    aged = (
        snapshot.filter(F.col("state").isin(list(states)) & (F.col("snapshot_id") < compare_id))
        .join(cases, "case_id")
        .filter(datediff_boundary("DAY", F.col("opened"), day) == age_days)
        .withColumnRenamed("state", "entry_state")
    )
    later = state_on(snapshot if compare is None else compare, "snapshot_id", compare_id).select("case_id", F.col("state").alias("later_state"))
    fell = F.col("fallout_at").isNotNull() & (F.to_date("fallout_at") <= compare_day)
    bucket = (
        F.when(fell, "Fallout").when(F.col("later_state").isin(list(states)), "Pipeline").otherwise("Closed")
    )
    end = F.to_date(F.coalesce("closed_at", "fallout_at"))
    bucket_end = F.when(fell, F.to_date("fallout_at")).when(
        F.col("later_state").isin(list(states)), compare_day
    ).otherwise(F.to_date("closed_at"))
    return aged.join(later, "case_id", "left").select(
        "case_id",
        "snapshot_id",
        "entry_state",
        "later_state",
        bucket.alias("bucket"),
        F.when(F.col("closed_at").isNotNull(), 1).otherwise(0).alias("pulled_through"),
        datediff_boundary("DAY", day, end).alias("turn_days"),
        datediff_boundary("DAY", day, bucket_end).alias("bucket_days"),
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("cases"), count_if(F.col("pulled_through") == 1).alias("pulled_through")
    )
