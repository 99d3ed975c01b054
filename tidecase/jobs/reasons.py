"""Reasons attached to events through a bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeat_reasons(events: DataFrame, bridge: DataFrame, at_least: int) -> DataFrame:
    """(case, reason) pairs on at least that many events, with first and last time.

    ``events``: case_id, ts, group_id; ``bridge``: group_id, reason. Each event counts once per reason.
    """
    reasons = bridge.select("group_id", "reason").distinct()
    return (
        events.join(reasons, "group_id")
        .groupBy("case_id", "reason")
        .agg(F.count(F.lit(1)).alias("times"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))
        .filter(F.col("times") >= at_least)
    )
