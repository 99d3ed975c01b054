"""Subtotals with labels, fixed pivots, unpivots, dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subtotals(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    aggs: Sequence[Column],
    total_label: str = "All",
    null_label: str = "Unknown",
    keep: Sequence[str] = (),
    depth: str | None = None,
) -> DataFrame:
    """GROUPING SETS whose group columns read ``total_label`` on subtotal rows, ``null_label`` for NULL.

    Columns in ``keep`` are left as they are. ``depth`` adds the number of rolled-up columns, for sorting totals
    first.
    """
    columns: list[str] = []
    for group in sets:
        columns += [c for c in group if c not in columns]
    marks = [F.grouping(c).alias("_grouping_" + c) for c in columns]
    result = df.groupingSets([list(s) for s in sets], *columns).agg(*aggs, *marks)
    added = [c for c in result.columns if c not in columns and not c.startswith("_grouping_")]
    labelled = [
        F.col(c)
        if c in keep
        else F.when(F.col("_grouping_" + c) == 1, total_label)
        .otherwise(F.coalesce(F.col(c).cast("string"), F.lit(null_label)))
        .alias(c)
        for c in columns
    ]
    extra = []
    if depth:
        total = sum((F.col("_grouping_" + c) for c in columns[1:]), F.col("_grouping_" + columns[0]))
        extra = [total.cast("int").alias(depth)]
    return result.select(*labelled, *added, *extra)


def pivot_fixed(
    df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], agg: Column
) -> DataFrame:
    """One column per listed value; listing them avoids a pass over the data to find them."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(agg)


def unpivot_nonnull(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """Columns to (name, value) rows, NULL values left out."""
    rows = df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)
    return rows.filter(F.col(value).isNotNull())


def dense_grid(
    entities: DataFrame, first: Column, last: Column, name: str = "day"
) -> DataFrame:
    """Every entity on every day of [first, last]; each row expands by itself, nothing is crossed."""
    return entities.withColumn(name, F.explode(F.sequence(first, last)))


def fill_grid(grid: DataFrame, facts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join fact summaries at the grid's grain."""
    for summary in facts:
        grid = grid.join(summary, list(keys), "left")
    return grid


def union_padded(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name, with NULL for columns a branch lacks."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
