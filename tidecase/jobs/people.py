"""Hours, effort, roster classes and time in role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecase.operators.intervals import version_join
from tidecase.operators.joins import semi
from tidecase.operators.slices import HotKeys
from tidecase.sources.scratch import stored


def hours_worked(entries: DataFrame, codes: list[int]) -> DataFrame:
    """Hours per worker and day. ``entries``: worker, date_id, minutes (decimal), code."""
    return (
        entries.filter(F.col("code").isin(codes))
        .groupBy("worker", "date_id")
        .agg((F.sum("minutes").cast("double") / 60.0).alias("hours"))
    )


def hours_by_leader(hours: DataFrame, leaders: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add the leader at the time: ``leaders`` are versions worker, leader, start_id, end_id."""
    return version_join(hours, leaders, ["worker"], "date_id", "start_id", "end_id", {"leader": "leader"}, hot=hot)


def effort_hours(touches: DataFrame, population: DataFrame, hours: DataFrame) -> DataFrame:
    """Hours per day of the distinct workers who touched the population on that day.

    ``touches``: case_id, worker, date_id; ``population``: case_id; ``hours``: worker, date_id, minutes (decimal).
    """
    involved = semi(touches, population, ["case_id"]).select("worker", "date_id").distinct()
    per_day = hours.groupBy("worker", "date_id").agg(F.sum("minutes").alias("minutes"))
    return (
        involved.join(per_day, ["worker", "date_id"])
        .groupBy("date_id")
        .agg(F.count(F.lit(1)).alias("workers"), (F.sum("minutes").cast("double") / 60.0).alias("hours"))
    )


def first_in_role(versions: DataFrame, role: str, open_end: int) -> DataFrame:
    """First day in ``role`` of everybody who holds it now. ``versions``: worker, role, start_id, end_id."""
    held = versions.filter(F.col("role") == role)
    return held.groupBy("worker").agg(
        F.min("start_id").alias("first_id"), F.max("end_id").alias("_end")
    ).filter(F.col("_end") == open_end).drop("_end")


def top_leaders(staff: DataFrame) -> DataFrame:
    """Each person's top leader and the number of levels to them, for chains of any length. ``staff``: id, leader.

    Pointers are doubled: in each round everybody who has not arrived jumps to the leader of the one they point at, as far as that one has
    come, so chains of n levels take log2(n) joins. Who has no leader is their own top at level 0, as is who has one that is not in ``staff``. Who is in a circle,
    or below one, never arrives and has no top: after a round in which nobody arrives, nobody will, as a longer chain has someone at every level below.
    """
    people = staff.dropna(subset=["id"]).dropDuplicates(["id"]).select("id", "leader")
    known = people.select(F.col("id").alias("_known"))
    joined = people.join(known, F.col("leader") == F.col("_known"), "left")
    # the pointer, the levels it goes up, and whether it points at a top
    state = stored(joined.select("id", F.coalesce("_known", "id").alias("at"), F.when(F.col("_known").isNull(), 0).otherwise(1).cast("bigint").alias("levels"), F.col("_known").isNull().alias("top")), "leaders")
    before = None
    while True:
        state = stored(_jump(state), "leaders")
        left = state.filter("NOT arrived").count()
        if left in (0, before):
            break
        before = left
    return state.select("id", F.when(F.col("arrived"), F.col("at")).alias("top_leader"), F.when(F.col("arrived"), F.col("levels")).alias("levels"))


def _jump(state: DataFrame) -> DataFrame:
    """Who points at a top has arrived; everybody else takes the pointer of the one they point at."""
    ahead = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("levels").alias("_levels"), F.col("top").alias("_top"))
    moved = state.filter("NOT top").join(ahead, F.col("at") == F.col("_id"))
    done = state.filter("top").select("id", "at", "levels", "top", F.lit(True).alias("arrived"))
    return done.unionByName(moved.select("id", F.col("_at").alias("at"), (F.col("levels") + F.col("_levels")).alias("levels"), F.col("_top").alias("top"), F.col("_top").alias("arrived")))
