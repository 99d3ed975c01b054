"""Call-centre reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import count_if, money_sum, safe_ratio
from tidecase.functions.timeid import half_hour
from tidecase.operators.joins import with_group


def volume_by_half_hour(calls: DataFrame, ts: str) -> DataFrame:
    """Calls per day and half hour, with the share of the day's total."""
    volume = calls.groupBy(F.to_date(ts).alias("day"), half_hour(ts).alias("slot")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    share = F.col("calls").cast("double") / F.col("_total")
    return with_group(volume, ["day"], F.sum("calls").alias("_total")).select("day", "slot", "calls", share.alias("share"))


def answer_rate(calls: DataFrame, keys: list[str], answered: Column, missed: Column) -> DataFrame:
    """Answered, missed and answered per hundred offered; NULL where nothing was offered."""
    counted = calls.groupBy(*keys).agg(count_if(answered).alias("answered"), count_if(missed).alias("missed"))
    offered = F.col("answered") + F.col("missed")
    return counted.withColumn("rate", safe_ratio(F.col("answered"), offered, 100.0))


def daily_averages(calls: DataFrame, ts: str, agent: str, talk: str) -> DataFrame:
    """Distinct agents, talk time, calls and calls per agent by day."""
    per_day = calls.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_distinct(agent).alias("agents"),
        money_sum(talk).alias("talk_time"),
        F.count(talk).alias("calls"),
    )
    return per_day.withColumn("calls_per_agent", safe_ratio(F.col("calls"), F.col("agents")))
