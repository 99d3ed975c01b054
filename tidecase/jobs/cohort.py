"""Pilot analysis: one wide row per case, and its reports by pilot and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import count_if, int_avg, money_avg
from tidecase.functions.timeid import datediff_boundary, week_of
from tidecase.jobs.dwell import visits_to_state
from tidecase.jobs.touches import distinct_touches, touches_by_role
from tidecase.jobs.turntime import turn_times
from tidecase.operators.shapes import subtotals
from tidecase.operators.slices import hot_keys
from tidecase.sources.scratch import stored

SETS = [["pilot", "week_of"], ["pilot"]]


def wide_row(
    cases: DataFrame,
    log: DataFrame,
    sessions: DataFrame,
    marks: dict[str, Column],
    hold: str,
    hold_mark: str,
    roles: list[str],
    weekday: str,
    as_of: Column,
) -> DataFrame:
    """Milestones, seconds to each, holds around ``hold_mark``, touches in total and by role, and the week.

    ``cases``: case_id, pilot, opened, amount; ``log``: case_id, ts, event_id, status; ``sessions``: case_id, worker, ts,
    seconds, role. All first-milestone stages are one aggregation over the log. Cases, milestones, holds and touches, one row per case each, are stored one by
    one: a task sorts and aggregates rows of one of them, and milestones are found once for the two steps that read them.
    """
    cases = stored(cases, "cases")
    hot = hot_keys(log.select("case_id", "ts", "event_id"), ["case_id"], ["ts", "event_id"])
    turned = stored(turn_times(cases, log, "case_id", "opened", "ts", marks, hot), "milestones")
    timed = turned.select(
        *cases.columns,
        week_of("opened", weekday).alias("week_of"),
        *marks,
        *[datediff_boundary("SECOND", "opened", m).alias(f"{m}_seconds") for m in marks],
    )
    holds = visits_to_state(log, turned.select("case_id", hold_mark), hold, hold_mark, as_of, hot=hot).drop(hold_mark)
    per_role = distinct_touches(sessions, "case_id", "worker", "ts", F.col("seconds"), ["role"])
    sums = [F.sum("touches").alias("touches"), F.sum("seconds").alias("touch_seconds")]
    by_role = touches_by_role(per_role, "case_id", "role", roles, total="distinct_touches", also=sums)
    return timed.join(stored(holds, "holds"), "case_id", "left").join(stored(by_role, "touches"), "case_id", "left")


def _share(condition: Column) -> Column:
    return count_if(condition).cast("double") / F.count(F.lit(1))


def _report(wide: DataFrame, aggs: list[Column]) -> DataFrame:
    return subtotals(wide, SETS, [F.count(F.lit(1)).alias("cases"), *aggs], total_label="Total", keep=["pilot"])


def speed_report(wide: DataFrame, marks: list[str]) -> DataFrame:
    """Cases, mean amount, share that reached each milestone and mean hours to it."""
    return _report(
        wide,
        [
            money_avg("amount").alias("avg_amount"),
            *[_share(F.col(m).isNotNull()).alias(f"{m}_share") for m in marks],
            *[(int_avg(f"{m}_seconds") / F.lit(3600.0)).alias(f"{m}_avg_hours") for m in marks],
        ],
    )


def touch_report(wide: DataFrame, roles: list[str]) -> DataFrame:
    """Mean touches, distinct touches, hours in the case, and distinct touches by role."""
    return _report(
        wide,
        [
            int_avg("touches").alias("avg_touches"),
            int_avg("distinct_touches").alias("avg_distinct"),
            (int_avg("touch_seconds") / F.lit(3600.0)).alias("avg_hours"),
            *[int_avg(r).alias(f"avg_{r}") for r in roles],
        ],
    )


def quality_report(wide: DataFrame) -> DataFrame:
    """Share of cases held at all, before and after the milestone."""
    return _report(
        wide,
        [
            _share(F.col("visits") > 0).alias("held_share"),
            _share(F.col("visits_before") > 0).alias("held_before_share"),
            _share(F.col("visits_after") > 0).alias("held_after_share"),
        ],
    )


def profile_report(wide: DataFrame, attributes: list[str]) -> DataFrame:
    """Cases and the mean of each attribute, NULLs left out."""
    return _report(wide, [money_avg(a).alias(f"avg_{a}") for a in attributes])
