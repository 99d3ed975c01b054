"""Turn times between milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import int_avg
from tidecase.functions.timeid import datediff_boundary
from tidecase.operators.events import milestones
from tidecase.operators.joins import spread_join
from tidecase.operators.slices import HotKeys


def turn_times(
    cases: DataFrame,
    log: DataFrame,
    case: str,
    opened: str,
    ts: str,
    marks: dict[str, Column],
    hot: HotKeys | None = None,
    last: bool = False,
) -> DataFrame:
    """Cases with the first (or last) time of each mark and ``<mark>_days`` / ``<mark>_hours`` since opening.

    Log rows before the case was opened do not count. All marks come from one pass over the log.
    """
    starts = cases.select(case, opened)
    since = spread_join(log, starts, [case], hot=hot).filter(F.col(ts) >= F.col(opened))
    firsts = milestones(since, [case], ts, marks, last)
    joined = cases.join(firsts, case, "left")
    return joined.select(
        *joined.columns,
        *[datediff_boundary("DAY", opened, m).alias(f"{m}_days") for m in marks],
        *[datediff_boundary("HOUR", opened, m).alias(f"{m}_hours") for m in marks],
    )


def turn_times_between(turned: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add ``<name>_days`` and ``<name>_hours`` between two time columns for each ``name: (from, to)``.

    NULL where either is missing, or where the second comes before the first.
    """
    def span(unit: str, start: str, end: str) -> Column:
        return F.when(F.col(end) >= F.col(start), datediff_boundary(unit, start, end))

    return turned.select(
        *turned.columns, *[span(unit, a, b).alias(f"{name}_{label}") for name, (a, b) in pairs.items() for unit, label in (("DAY", "days"), ("HOUR", "hours"))]
    )


def earlier_of(name: str, first: str, second: str) -> Column:
    """The earlier of two marks, the one there is where the other is missing."""
    return F.least(first, second).alias(name)  # least ignores NULL


def average_turn_times(turned: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Cases, cases that reached each mark, and mean days to it."""
    return turned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.count(m).alias(f"{m}_cases") for m in marks],
        *[int_avg(f"{m}_days").alias(f"{m}_avg_days") for m in marks],
    )
