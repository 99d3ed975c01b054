"""Questions about the state of a case at, before or after some moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.timeid import dateadd, datediff_boundary
from tidecase.operators.events import asof, last_event
from tidecase.operators.joins import anti
from tidecase.operators.slices import ROWS_PER_TASK, HotKeys, hot_keys, with_prev


def hot_cases(log: DataFrame, rows_per_task: int, *also: str) -> HotKeys:
    """Hot cases of a log (case_id, ts, …) by itself: what is joined to it, with one row per case, need not be computed to find them."""
    return hot_keys(log.select("case_id", "ts", *also), ["case_id"], ["ts"], rows_per_task)


def state_at_event(
    calls: DataFrame, status_log: DataFrame, rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None
) -> DataFrame:
    """Add the case's status just before each call and its status now.

    ``calls``: case_id, ts, …; ``status_log``: case_id, ts, event_id, status.
    """
    at_call = asof(
        calls, status_log, ["case_id"], "ts", "ts", {"status_at_call": "status"}, ties=["event_id"], rows_per_task=rows_per_task, hot=hot
    )
    now = last_event(status_log, ["case_id"], ["ts", "event_id"]).select("case_id", F.col("status").alias("status_now"))
    return at_call.join(now, "case_id", "left")


def increase_after(
    approvals: DataFrame, values: DataFrame, rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None
) -> DataFrame:
    """Cases whose current value is above the value at their latest approval.

    ``approvals``: case_id, ts; ``values``: case_id, ts, event_id, value.
    """
    approved = approvals.groupBy("case_id").agg(F.max("ts").alias("approved_at"))
    at_approval = asof(
        approved, values, ["case_id"], "approved_at", "ts", {"approved_value": "value"},
        strict=False, how="inner", ties=["event_id"], rows_per_task=rows_per_task,
        hot=hot or hot_cases(values, rows_per_task, "event_id"),
    )
    newest = last_event(values, ["case_id"], ["ts", "event_id"]).select(
        "case_id", F.col("value").alias("current_value"), F.col("ts").alias("changed_at")
    )
    return at_approval.join(newest, "case_id").filter(F.col("current_value") > F.col("approved_value"))


def reopened_aging(
    log: DataFrame, reopened: str, cleared: list[str], as_of: Column, rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None
) -> DataFrame:
    """Latest time each case went from a cleared status back to ``reopened``, and days since.

    ``log``: case_id, ts, event_id, status.
    """
    stepped = with_prev(log, ["case_id"], ["ts", "event_id"], {"_prev": "status"}, rows_per_task, hot)
    again = stepped.filter((F.col("status") == reopened) & F.col("_prev").isin(cleared))
    latest = last_event(again, ["case_id"], ["ts", "event_id"])
    days = datediff_boundary("MINUTE", F.col("ts"), as_of) / F.lit(1440.0)
    return latest.select("case_id", F.col("ts").alias("reopened_at"), days.alias("days_open"))


def second_order(orders: DataFrame, large: Column, very_large: Column) -> DataFrame:
    """Clients with exactly one large order, and the date from which it counts.

    That is the order date, or the first very large order where that is later. ``orders``: client, ts.
    """
    facts = orders.groupBy("client").agg(
        F.count(F.when(large, 1)).alias("_large"),
        F.min(F.when(large, F.col("ts"))).alias("ordered"),
        F.min(F.when(very_large, F.col("ts"))).alias("_raised"),
    )
    report = F.when(F.col("_raised") >= F.col("ordered"), F.col("_raised")).otherwise(F.col("ordered"))
    return facts.filter("_large = 1").select("client", "ordered", report.alias("report_date"))


def prior_match(
    cases: DataFrame, earlier: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None
) -> DataFrame:
    """Each case with the latest earlier case of the same keys. Both: keys, ts, case_id."""
    return asof(
        cases, earlier, keys, "ts", "ts", {"prior_case": "case_id", "prior_ts": "ts"},
        ties=["case_id"], rows_per_task=rows_per_task, hot=hot,
    )


def missing_followup(
    cases: DataFrame, followups: DataFrame, status_log: DataFrame, days_valid: int, rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Cases that expired ``days_valid`` after opening, before they were taken up, with no follow-up.

    ``cases``: case_id, opened, taken_up, closed_at (the bound where ``taken_up`` is NULL); ``followups``: case_id;
    ``status_log``: case_id, ts, status, tie. Adds the case's status just before expiry.
    """
    bound = F.when(F.col("taken_up").isNull(), F.col("closed_at")).otherwise(F.col("taken_up"))
    dated = cases.withColumn("expired", dateadd("DAY", days_valid, "opened")).filter(F.col("expired") < bound)
    lacking = anti(dated, followups, ["case_id"])
    return asof(
        lacking, status_log, ["case_id"], "expired", "ts", {"status_at_expiry": "status"},
        ties=["tie"], rows_per_task=rows_per_task, hot=hot or hot_cases(status_log, rows_per_task, "tie"),
    )

