"""Aggregate expressions that do not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecase.functions.timeid import _col

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    return _col(c).cast(MONEY)


def money_sum(c: Column | str) -> Column:
    """Exact sum of amounts with two decimals: the same at any partitioning, unlike a double sum."""
    return F.sum(money(c)).cast("double")


def money_avg(c: Column | str) -> Column:
    return F.sum(money(c)).cast("double") / F.count(_col(c))


def int_avg(c: Column | str) -> Column:
    """Mean of whole numbers as a double, from an exact sum."""
    return F.sum(_col(c).cast("bigint")).cast("double") / F.count(_col(c))


def safe_ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``scale * n / d``, NULL when the denominator is zero."""
    d = denominator.cast("double")
    return F.lit(scale) * numerator.cast("double") / F.when(d != 0, d)


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also when it is NULL)."""
    return F.when(condition, 1).otherwise(0)


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: Column | int = 1) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.sum(F.when(condition, value).otherwise(0))


def any_flag(condition: Column) -> Column:
    """'Yes' when any row of the group meets the condition."""
    return yes_no(F.max(flag(condition)) > 0)
