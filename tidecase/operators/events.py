"""Event-log operators: first, last, n-th event per key, milestones, as-of joins, time in state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecase.functions.timeid import datediff_boundary
from tidecase.operators.slices import (
    ROWS_PER_TASK,
    SLICE,
    HotKeys,
    carry,
    directed,
    hot_keys,
    join_carry,
    sliced_rows,
    with_next,
)


def top_n(log: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "_rn") -> DataFrame:
    """First ``n`` rows per key in the given order, numbered.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per key and map task before the shuffle, so a
    key with very many rows sends few of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def first_event(
    log: DataFrame, keys: list[str], order: list[str], where: Column | None = None
) -> DataFrame:
    """The earliest row per key. End ``order`` with a unique column to make ties stable."""
    rows = log if where is None else log.filter(where)
    return top_n(rows, keys, directed(order, False), 1).drop("_rn")


def last_event(
    log: DataFrame, keys: list[str], order: list[str], where: Column | None = None
) -> DataFrame:
    """The latest row per key."""
    rows = log if where is None else log.filter(where)
    return top_n(rows, keys, directed(order, True), 1).drop("_rn")


def nth_event(
    log: DataFrame, keys: list[str], order: list[str], n: int, where: Column | None = None
) -> DataFrame:
    """The ``n``-th row per key; keys with fewer rows are absent."""
    rows = log if where is None else log.filter(where)
    return top_n(rows, keys, directed(order, False), n).filter(F.col("_rn") == n).drop("_rn")


def milestones(log: DataFrame, keys: list[str], ts: str, marks: dict[str, Column], last: bool = False) -> DataFrame:
    """First (or last) time each mark's condition held, one row per key, in a single pass over the log."""
    pick = F.max if last else F.min
    return log.groupBy(*keys).agg(
        *[pick(F.when(condition, F.col(ts))).alias(name) for name, condition in marks.items()]
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    columns: dict[str, str],
    direction: str = "backward",
    strict: bool = True,
    how: str = "left",
    ties: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Per left row, ``{new name: right column}`` of the nearest right row before (or after) it.

    ``strict`` keeps right rows at exactly the same time out. ``ties`` orders right rows at one
    time: backward takes the last of them, forward the first. Both sides go through one shuffle as
    one sorted sequence, so the cost is linear in rows and no pairs are formed within a key.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    forward = direction == "forward"
    ties = ties or []
    # which side comes first among rows at one time, in the direction of travel
    left_rank, right_rank = (0, 1) if strict != forward else (1, 0)
    tie_columns = [f"_tie{i}" for i in range(len(ties))]
    key_columns = [f"_key{i}" for i in range(len(keys))]
    null_left = F.lit(None).cast(left.schema)
    payload = F.struct(*[F.col(source).alias(out) for out, source in columns.items()])
    matchable = right.dropna(subset=[*keys, right_ts])
    right_types = right.select(payload.alias("p")).schema["p"].dataType

    left_rows = left.select(
        *[F.col(k).alias(a) for k, a in zip(keys, key_columns)],
        F.col(left_ts).alias("_ts"),
        F.lit(left_rank).alias("_side"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(a) for t, a in zip(ties, tie_columns)],
        F.xxhash64(*left.columns).alias("_mix"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right_types).alias("_right"),
    )
    right_rows = matchable.select(
        *[F.col(k).alias(a) for k, a in zip(keys, key_columns)],
        F.col(right_ts).alias("_ts"),
        F.lit(right_rank).alias("_side"),
        *[F.col(t).alias(a) for t, a in zip(ties, tie_columns)],
        F.xxhash64(*right.columns).alias("_mix"),
        null_left.alias("_left"),
        payload.alias("_right"),
    )
    rows = left_rows.unionByName(right_rows)
    # the hash keeps rows of one side and time apart, so that they too can be cut into slices
    order = ["_ts", "_side", *tie_columns, "_mix"]
    if hot is None:
        # the row id lets equal rows be drawn one by one
        narrow = rows.drop("_left", "_right").withColumn("_row", F.monotonically_increasing_id())
        hot = hot_keys(narrow, key_columns, order, rows_per_task)
    is_left, known_time = F.col("_side") == left_rank, F.col("_ts").isNotNull()
    so_far = F.last("_right", ignorenulls=True)

    def seen(by: list[str]) -> Column:
        window = Window.partitionBy(*by).orderBy(*directed(order, forward))
        return F.when(known_time, so_far.over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    if not hot.found:
        matched = rows.withColumn("_match", seen(key_columns)).filter(is_left)
    else:
        both = sliced_rows(rows, key_columns, order, hot)
        pick = F.min_by if forward else F.max_by
        newest = pick(F.when(~is_left, F.col("_right")), F.when(~is_left, F.struct("_ts", *tie_columns, "_mix")))
        carried = carry(both, key_columns, newest, lambda c: F.last(c, ignorenulls=True), forward, "_carried")
        near = both.withColumn("_match", seen([*key_columns, SLICE])).filter(is_left)
        found = F.coalesce(F.col("_match"), F.when(known_time, F.col("_carried")))
        matched = join_carry(near, carried, key_columns).withColumn("_match", found)
    if how == "inner":
        matched = matched.filter(F.col("_match").isNotNull())
    return matched.select("_left.*", *[F.col("_match." + out).alias(out) for out in columns])


def dwell(
    log: DataFrame,
    keys: list[str],
    order: list[str],
    state: str,
    as_of: Column,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Seconds and visits per (key, state); the last interval of a key ends at ``as_of``."""
    ts = order[0]
    stepped = with_next(log, keys, order, {"_until": ts}, rows_per_task, hot)
    seconds = datediff_boundary("SECOND", F.col(ts), F.coalesce(F.col("_until"), as_of))
    return stepped.groupBy(*keys, state).agg(
        F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("visits")
    )

