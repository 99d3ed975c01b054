"""Standard views over an event log: versions, daily snapshot, current status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecase.functions.timeid import dateid, dateid_between
from tidecase.operators.events import last_event
from tidecase.operators.intervals import versions
from tidecase.operators.slices import ROWS_PER_TASK, hot_keys, with_next

OPEN_END = 21991231


def state_versions(events: DataFrame) -> DataFrame:
    """Per user: state, valid_from, valid_to (NULL while current)."""
    return versions(
        events.withColumnRenamed("event_type", "state"), ["user_id"], ["ts", "event_id"], ["state", "event_id"]
    )


def daily_versions(
    log: DataFrame, keys: list[str], order: list[str], value: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Versions at day grain with inclusive date ids; the last one ends at the sentinel 21991231.

    The last change of a day counts for the whole day.
    """
    ts = order[0]
    hot = hot_keys(log.select(*keys, *order), keys, order, rows_per_task)
    daily = last_event(log.withColumn("_day", F.to_date(ts)), [*keys, "_day"], order)
    stepped = with_next(daily.select(*keys, "_day", ts, value), keys, [ts], {"_next": "_day"}, rows_per_task, hot)
    return stepped.select(
        *keys,
        value,
        dateid("_day").alias("start_id"),
        F.coalesce(dateid(F.date_sub("_next", 1)), F.lit(OPEN_END)).alias("end_id"),
    )


def daily_snapshot(events: DataFrame, only_id: int | None = None) -> DataFrame:
    """Latest event per user and calendar day; with ``only_id`` of that day, read by a filter on the time."""
    rows = events if only_id is None else events.filter(dateid_between("ts", only_id, only_id))
    days = rows.withColumn("snapshot_id", dateid("ts"))
    return last_event(days, ["user_id", "snapshot_id"], ["ts", "event_id"]).select(
        "user_id", "snapshot_id", "event_id", F.col("event_type").alias("state")
    )


def current_status(events: DataFrame) -> DataFrame:
    """Latest event per user."""
    return last_event(events, ["user_id"], ["ts", "event_id"])
