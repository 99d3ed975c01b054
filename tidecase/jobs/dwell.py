"""Visits to a state, time spent in it, and presence per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import count_if, sum_if
from tidecase.functions.timeid import datediff_boundary
from tidecase.operators.joins import spread_join
from tidecase.operators.slices import ROWS_PER_TASK, HotKeys, hot_keys, with_next


def visits_to_state(
    log: DataFrame,
    cases: DataFrame,
    state: str,
    milestone: str,
    as_of: Column,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Per case: visits to ``state`` in total, before and after its milestone, and hours spent there.

    ``log``: case_id, ts, event_id, status. ``cases``: case_id and the milestone column. Reasons are
    not joined before counting, so an event with several reasons counts once.
    """
    if hot is None:
        hot = hot_keys(log.select("case_id", "ts", "event_id"), ["case_id"], ["ts", "event_id"], rows_per_task)
    stepped = with_next(log, ["case_id"], ["ts", "event_id"], {"_until": "ts"}, rows_per_task, hot)
    visits = stepped.filter(F.col("status") == state)
    seconds = datediff_boundary("SECOND", F.col("ts"), F.coalesce(F.col("_until"), as_of))
    per_case = (
        spread_join(visits, cases.select("case_id", F.col(milestone).alias("_mark")), ["case_id"], "left", hot=hot)
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            count_if(F.col("ts") < F.col("_mark")).alias("visits_before"),
            count_if(F.col("ts") > F.col("_mark")).alias("visits_after"),
            (F.sum(seconds) / F.lit(3600.0)).alias("hours"),
        )
    )
    return cases.join(per_case, "case_id", "left").fillna(0, ["visits", "visits_before", "visits_after"])


def presence_time(
    log: DataFrame, away: str, online: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Seconds logged in (any state but ``away``) and online per agent and day.

    ``log``: agent, ts, event_id, status. Intervals do not run over midnight; the last state of a day has no length.
    """
    dated = log.withColumn("day", F.to_date("ts"))
    stepped = with_next(dated, ["agent", "day"], ["ts", "event_id"], {"_until": "ts"}, rows_per_task)
    per_state = (
        stepped.groupBy("day", "agent", "status")
        .agg(F.sum(datediff_boundary("SECOND", "ts", "_until")).alias("seconds"))
        .filter("seconds > 0")
    )
    return per_state.groupBy("day", "agent").agg(
        sum_if(F.col("status") != away, F.col("seconds")).alias("logged_in"),
        sum_if(F.col("status") == online, F.col("seconds")).alias("online"),
    )
