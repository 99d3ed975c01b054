"""Weighted unit scorecard per worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.operators.joins import apply_agg


def weight(key: Column, rules: Sequence[tuple[str, float]]) -> Column:
    """First rule (LIKE pattern, weight) that fits the key; NULL when none does, so gaps can be counted."""
    chain = None
    for pattern, units in rules:
        chain = F.when(key.like(pattern), units) if chain is None else chain.when(key.like(pattern), units)
    return chain


def adjusted_weight(key: Column, condition: Column, rules: Sequence[tuple[str, float, float]]) -> Column:
    """Like ``weight`` with two weights per rule: the plain one, and the one where ``condition`` holds."""
    chain = None
    for pattern, units, adjusted in rules:
        value = F.when(condition, adjusted).otherwise(units)
        chain = F.when(key.like(pattern), value) if chain is None else chain.when(key.like(pattern), value)
    return chain


# fixed values: share of status units and of closing units in the total
STATUS_SHARE, CLOSING_SHARE = 0.75, 0.25


def unit_scorecard(
    statuses: DataFrame,
    closings: DataFrame,
    worker: str,
    status_share: float = STATUS_SHARE,
    closing_share: float = CLOSING_SHARE,
) -> DataFrame:
    """Counts, units and the weighted total per worker; workers of either side are kept.

    Both inputs carry ``units`` as decimals, summed exactly. Rows that no rule covers have NULL units and are counted in
    ``unmapped``.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(worker).agg(
            F.count(F.lit(1)).alias(f"{name}_count"),
            F.sum("units").cast("double").alias(f"{name}_units"),
            F.count(F.when(F.col("units").isNull(), 1)).alias(f"{name}_unmapped"),
        )

    both = side(statuses, "status").join(side(closings, "closing").withColumnRenamed(worker, "_worker"), F.col(worker).eqNullSafe(F.col("_worker")), "full")
    both = both.withColumn(worker, F.coalesce(worker, "_worker")).drop("_worker")
    # cases without a worker stay together under NULL
    both = both.fillna(0, [c for c in both.columns if c != worker])
    total = F.col("status_units") * status_share + F.col("closing_units") * closing_share
    unmapped = F.col("status_unmapped") + F.col("closing_unmapped")
    return both.select(
        worker, "status_count", "status_units", "closing_count", "closing_units", total.alias("total"), unmapped.alias("unmapped")
    )


def with_leaders(scores: DataFrame, staff: DataFrame, worker: str, staff_key: str, columns: list[str]) -> DataFrame:
    """Add the worker's leader columns."""
    return apply_agg(scores, staff, {worker: staff_key}, [F.max(c).alias(c) for c in columns])
