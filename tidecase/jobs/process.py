"""Entry into a process by the first of two triggers, its sub-bucket, exit and duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.functions.measures import count_if
from tidecase.functions.timeid import datediff_boundary


def process_entry(
    log: DataFrame, scrub: Column, suspend: Column, help_needed: Column, exit_mark: Column, as_of: Column
) -> DataFrame:
    """``log``: case_id, ts. The four conditions mark log rows; all facts come from one aggregation."""

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("ts")))

    facts = log.groupBy("case_id").agg(
        first(scrub).alias("scrubbed"),
        first(suspend).alias("suspended"),
        first(help_needed).alias("helped"),
        count_if(help_needed).alias("help_count"),
        F.max(F.when(exit_mark, F.col("ts"))).alias("exited"),
    )
    entered = F.least("scrubbed", "suspended")
    by_scrub = F.col("suspended").isNull() | (F.col("scrubbed") < F.col("suspended"))
    has_help, has_hold = F.col("help_count") > 0, F.col("suspended").isNotNull()
    # a case that was never scrubbed has no order of help and hold to report
    order = F.when(F.col("scrubbed").isNull(), "").when(
        F.col("helped") < F.col("suspended"), "help then hold"
    ).otherwise("hold then help")
    bucket = F.when(has_help & has_hold, order).when(has_help, "help only").when(has_hold, "hold only").otherwise("neither")
    left_at = F.coalesce(F.when(F.col("exited") >= entered, F.col("exited")), as_of)
    return facts.filter(entered.isNotNull()).select(
        "case_id",
        F.to_date(entered).alias("entered"),
        F.when(by_scrub, "scrub").otherwise("hold").alias("entry_event"),
        "help_count",
        F.when(has_hold, "True").otherwise("False").alias("ever_held"),
        bucket.alias("sub_bucket"),
        F.to_date(left_at).alias("exited"),
        datediff_boundary("DAY", entered, left_at).alias("days_in_process"),
    )
