"""Expiry a number of business days after an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.business import Holidays, add_business_days, business_days


def business_expiry(
    requests: DataFrame, n: int, as_of: Column, holidays: Holidays = ()
) -> DataFrame:
    """Per case: number of requests, day of the latest, the ``n``-th business day after it and business days so far.

    ``requests``: case_id, ts.
    """
    facts = requests.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("requests"), F.max(F.to_date("ts")).alias("last_request")
    )
    dated = facts.withColumn("expires", add_business_days("last_request", n, holidays))
    elapsed = business_days(F.date_add("last_request", 1), as_of, holidays)
    return dated.withColumn("business_days", F.greatest(elapsed, F.lit(0)))
