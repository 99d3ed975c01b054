"""Charges against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import money_sum


def unexpected_totals(charges: DataFrame, keys: list[str], amount: str, as_expected: Column) -> DataFrame:
    """Totals per key that break the rule ``as_expected`` (written over ``keys`` and ``total``).

    A rule that is NULL for a row counts as broken.
    """
    totals = charges.groupBy(*keys).agg(money_sum(amount).alias("total"))
    return totals.filter(~F.coalesce(as_expected, F.lit(False)))


def charges_behind(charges: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The single charges behind unexpected totals."""
    return charges.join(totals, keys)
