"""Correlated-apply patterns as plain joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.operators.slices import ROWS_PER_TASK, HotKeys, copies, heavy_keys, is_small, same_keys
from tidecase.sources.scratch import stored


def apply_agg(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str] | list[str],
    aggs: Sequence[Column],
    how: str = "left",
    zero_fill: Sequence[str] = (),
) -> DataFrame:
    """Aggregate ``right`` per key, then join it to ``left`` (``keys``: left column to right column).

    The aggregate runs before the join, so the join sees one row per key. ``zero_fill`` names counts
    that read 0 instead of NULL for keys without rows.
    """
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    summary = right.groupBy(*[F.col(r).alias("_r_" + l) for l, r in pairs.items()]).agg(*aggs)
    on = reduce(Column.__and__, [F.col(l) == F.col("_r_" + l) for l in pairs])
    joined = left.join(summary, on, how).drop(*["_r_" + l for l in pairs])
    return joined.fillna(0, subset=list(zero_fill)) if zero_fill else joined


def _matching(left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str], how: str) -> DataFrame:
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    # distinct combines before the shuffle, so a key with very many rows arrives once per map task
    side = right.select(*[F.col(r).alias("_r_" + l) for l, r in pairs.items()]).distinct()
    on = reduce(Column.__and__, [F.col(l) == F.col("_r_" + l) for l in pairs])
    return left.join(side, on, how)


def semi(left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str]) -> DataFrame:
    """Left rows with a match; each once."""
    return _matching(left, right, keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str]) -> DataFrame:
    """Left rows without a match."""
    return _matching(left, right, keys, "left_anti")


def exists_flag(
    left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str], name: str
) -> DataFrame:
    """Add 1/0: does any right row match? Never multiplies left rows."""
    return apply_agg(left, right, keys, [F.max(F.lit(1)).alias(name)], "left", [name])


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join many facts to a lookup with one row per key, facts of heavy keys spread over several tasks.

    Facts of a heavy key get a salt from a hash of the row, the lookup row of that key is repeated per salt.
    Use it where the result is grouped or joined by the same keys again: adaptive execution leaves a skewed join
    alone there, since splitting it would cost another shuffle. Elsewhere a plain join does, as it does for facts of few bytes and for those
    without a heavy key: tables bucketed by the key then join without a shuffle.
    """
    if is_small(facts, rows_per_task) if hot is None else not hot.found:
        return facts.join(lookup, keys, how)
    if hot is None:
        hot = stored(heavy_keys(facts, keys, rows_per_task), "heavy")
        if hot.isEmpty():
            return facts.join(lookup, keys, how)
    else:
        hot = hot.table.select(*[f"_hot{i}" for i in range(len(keys))], "_parts")
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*facts.columns), F.col("_parts"))).otherwise(0)
    salted = facts.join(F.broadcast(hot), same_keys(keys, "_hot"), "left").select(
        *facts.columns, salt.cast("int").alias("_salt")
    )
    salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    repeated = lookup.join(F.broadcast(hot), same_keys(keys, "_hot"), "left").select(
        *lookup.columns, salts.alias("_salt")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def left_fan_out(
    lookup: DataFrame, facts: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``lookup LEFT JOIN facts`` where one key may have very many facts.

    An outer join cannot split the side that may be missing, so the matching rows come from a spread inner join and the
    unmatched lookup rows from an anti join.
    """
    matched = spread_join(facts, lookup, keys, "inner", rows_per_task)
    return matched.unionByName(anti(lookup, facts, keys), allowMissingColumns=True)


def with_group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row (``agg() OVER (PARTITION BY keys)``).

    Built as aggregate plus join: the aggregate combines before the shuffle and the join can be broadcast or
    split, whereas a window would put each group into one task.
    """
    totals = df.groupBy(*keys).agg(*aggs)
    added = [c for c in totals.columns if c not in keys]
    totals = totals.select(*copies(keys, "_group"), *added)
    return df.join(totals, same_keys(keys, "_group"), "left").select(*df.columns, *added)
