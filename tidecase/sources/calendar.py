"""Calendar dimension over the date range of a fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecase.functions.business import Holidays, is_business_day, is_holiday
from tidecase.functions.timeid import dateid, month_name


def days_of(facts: DataFrame, ts: str) -> DataFrame:
    """One row per date from the first to the last fact, computed in the plan."""
    bounds = facts.agg(
        F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last")
    )
    return bounds.select(
        F.explode(F.sequence("first", "last")).alias("date")
    )


def calendar(days: DataFrame, holidays: Holidays = ()) -> DataFrame:
    """Attributes per date: id, names, month and quarter keys, weekend, holiday and business flags."""
    holidays = list(holidays)
    return days.select(
        "date",
        dateid("date").alias("date_id"),
        F.date_format("date", "EEEE").alias("day_name"),
        month_name("date").alias("month_name"),
        (F.year("date") * 100 + F.month("date")).alias("month_key"),
        (F.year("date") * 10 + F.quarter("date")).alias("quarter_key"),
        F.dayofweek("date").alias("weekday_key"),
        F.when(F.weekday("date") >= 5, 1).otherwise(0).alias("weekend_flag"),
        F.when(is_holiday("date", holidays), 1).otherwise(0).alias("holiday_flag"),
        F.when(is_business_day("date", holidays), 1).otherwise(0).alias("business_flag"),
    )
