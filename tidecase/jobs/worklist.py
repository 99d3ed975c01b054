"""Multi-signal work list: one wide row per open case, many result sets from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import flag, yes_no
from tidecase.functions.timeid import datediff_boundary
from tidecase.operators.events import last_event, top_n
from tidecase.operators.joins import semi
from tidecase.operators.shapes import pivot_fixed, unpivot_nonnull
from tidecase.sources.scratch import stored_by
from tidecase.sources.sinks import ResultSet


def days_since(ts: Column | str, as_of: Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return datediff_boundary("SECOND", ts, as_of) / F.lit(86400.0)


def review_columns(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Latest status and its time per case and kind of review, as ``<kind>_status`` / ``<kind>_since``.

    ``items``: case_id, kind, status, ts, tie.
    """
    latest = last_event(items, ["case_id", "kind"], ["ts", "tie"], F.col("kind").isin(kinds))
    texts = latest.select(
        "case_id", "kind", F.col("status").cast("string").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("since")
    )
    long = unpivot_nonnull(texts, ["case_id", "kind"], ["status", "since"], "attribute", "text")
    named = long.select("case_id", F.concat_ws("_", "kind", "attribute").alias("name"), "text")
    return pivot_fixed(named, ["case_id"], "name", [f"{k}_{a}" for k in kinds for a in ("status", "since")], F.max("text"))


def case_rows(rows: DataFrame, case: str, cases: DataFrame) -> DataFrame:
    """Rows of the listed cases, stored once, bucketed by case: windows and joins by case read them without a shuffle."""
    return stored_by(semi(rows, cases, {case: "case_id"}), [case], [case], dealt=True)


def work_list(
    cases: DataFrame, items: DataFrame, conditions: DataFrame, kinds: list[str], waiting: list[str], as_of: Column
) -> DataFrame:
    """The wide row. ``cases``: case_id, status, opened; ``items``: case_id, kind, status, ts, tie;
    ``conditions``: case_id, ts (open conditions only).

    The leading review prefers items in a waiting status, then the oldest. Items and conditions made from ``case_rows`` are not shuffled by case again.
    """
    urgency = F.when(F.col("status").isin(waiting), 1).otherwise(0)
    leading = top_n(items, ["case_id"], [urgency.desc(), F.col("ts"), F.col("tie")], 1).select(
        "case_id", F.col("status").alias("review_status"), F.col("ts").alias("review_since")
    )
    open_conditions = conditions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("open_conditions"), F.min("ts").alias("oldest_condition")
    )
    reviews = review_columns(items, kinds)
    joined = (
        cases.join(leading, "case_id", "left")
        .join(open_conditions, "case_id", "left")
        .join(reviews, "case_id", "left")
        .fillna(0, ["open_conditions"])
    )
    any_waiting = F.lit(0)
    for kind in kinds:
        any_waiting = any_waiting + flag(F.col(f"{kind}_status").isin(waiting))
    return joined.select(
        *joined.columns,
        days_since("opened", as_of).alias("days_open"),
        days_since("review_since", as_of).alias("days_in_review"),
        days_since("oldest_condition", as_of).alias("days_with_condition"),
        yes_no(any_waiting > 0).alias("review_incomplete"),
    )


def signals(kinds: list[str], waiting: list[str]) -> dict[str, tuple[Column, Column]]:
    """The report's result sets: which cases belong to each, and the days to list."""
    found = {
        "conditions": (F.col("open_conditions") > 0, F.col("days_with_condition")),
        "incomplete": (F.col("review_incomplete") == "Yes", F.col("days_in_review")),
        "never reviewed": (F.col("review_status").isNull(), F.col("days_open")),
    }
    for kind in kinds:
        found[kind] = (F.col(f"{kind}_status").isin(waiting), F.col("days_open"))
    return found


def result_sets(wide: DataFrame, found: dict[str, tuple[Column, Column]]) -> dict[str, DataFrame]:
    """One DataFrame per result set; ``layouts`` has those of the whole report."""
    return {
        name: wide.filter(condition).select("case_id", days.alias("days"))
        for name, (condition, days) in found.items()
    }


def signal_rows(wide: DataFrame, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All result sets as (result, case_id, days) rows from a single pass over the wide row."""
    entries = [
        F.when(condition, F.struct(F.lit(name).alias("result"), days.alias("days")))
        for name, (condition, days) in found.items()
    ]
    listed = wide.select("case_id", F.explode(F.array_compact(F.array(*entries))).alias("_s"))
    return listed.select("case_id", "_s.result", "_s.days")


def suspended(kinds: list[str], state: str) -> Column:
    """Which reviews are in ``state``: the kind, ``Both`` for more than one, ``No`` for none."""
    hits = [flag(F.col(f"{k}_status").eqNullSafe(state)) for k in kinds]
    count = sum(hits[1:], hits[0])
    name = F.coalesce(*[F.when(h == 1, k) for h, k in zip(hits, kinds)])
    return F.when(count > 1, "Both").when(count == 1, name).otherwise("No")


def layouts(kinds: list[str], waiting: list[str], held: str, done: list[str], old: int, as_of: Column) -> dict[str, ResultSet]:
    """The report's ten result sets over the wide row, each with its filter, columns and order.

    ``kinds``: the three reviews, in the order of the work; ``held``: the status of a suspended review; ``done``: statuses of the leading
    review that leave a case sitting; ``old``: days from which a case is aging. Besides the wide row's columns they read ``priority`` ("1-…") and ``amount``.
    """
    first, second, third = kinds
    c = F.col
    since = {k: days_since(c(f"{k}_since").cast("timestamp_ntz"), as_of) for k in kinds}
    label = suspended(kinds[:2], held)
    case = {"case_id": c("case_id")}
    status = {"priority": c("priority"), "days_open": c("days_open")}
    waits = {"has_conditions": yes_no(c("open_conditions") > 0), "days_with_condition": c("days_with_condition")}
    aging = yes_no(c("days_open") >= old)

    def days_first(days: Column) -> list[Column]:
        return [c("days").desc_nulls_last(), c("case_id")]

    def listed(where: Column, days: Column, **more: Column) -> ResultSet:
        return ResultSet(where, {**case, "days": days, **status, **more}, days_first(days))

    number = c("priority").substr(1, 1).cast("int")
    every = {n: c(n) for n in ("review_status", "days_in_review", "open_conditions", "review_incomplete")}
    return {
        "all": ResultSet(F.lit(True), {**case, **status, **every, **waits, "suspense": label, "aging": aging}, [number, c("days_open").desc(), c("case_id")]),
        "high_risk": listed(c("amount") > 300000, c("days_in_review")),
        "first_review": listed(c(f"{first}_status").isin(waiting), since[first], **waits),
        "second_review": listed(c(f"{second}_status").isin(waiting), since[second], other_status=c(f"{first}_status"), other_days=since[first], suspense=label),
        "third_review": listed(c(f"{third}_status").isin(waiting), since[third]),
        "conditions": listed(c("open_conditions") > 0, c("days_with_condition"), open_conditions=c("open_conditions"), review_incomplete=c("review_incomplete")),
        "aging": listed((c("days_open") >= old) & (c("review_incomplete") == "Yes"), c("days_open"), review_status=c("review_status"), days_in_review=c("days_in_review"), open_conditions=c("open_conditions"), **waits),
        "sitting": listed(c("priority").like("%2-%") & (c("review_status").isin(done) | (aging == "No")), c("days_in_review"), review_status=c("review_status"), aging=aging, **waits),
        "never_reviewed": listed(c("review_status").isNull(), c("days_open"), amount=c("amount")),
        "suspense": ResultSet(label != "No", {**case, "suspense": label, "days": F.greatest(since[first], since[second]), **status, "other_status": c(f"{first}_status"), "last_status": c(f"{second}_status")}, [c("suspense").desc(), c("days").desc_nulls_last(), c("case_id")]),
    }
