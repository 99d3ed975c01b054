"""One numbered event log per case from several sources, and funnel counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.operators.slices import ROWS_PER_TASK, HotKeys, numbered


def assemble(
    sources: list[DataFrame], rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None
) -> DataFrame:
    """Union sources of (case_id, status, ts), drop repeats, number the events per case by time."""
    rows = sources[0].select("case_id", "status", "ts")
    for df in sources[1:]:
        rows = rows.unionByName(df.select("case_id", "status", "ts"))
    return numbered(rows.distinct(), ["case_id"], ["ts", "status"], "row_num", rows_per_task=rows_per_task, hot=hot)


def labelled(log: DataFrame, labels: dict[str, Column], first_only: tuple[str, ...] = ()) -> DataFrame:
    """Log rows under the first label whose condition they meet; of ``first_only`` labels the earliest per case.

    One pass and one aggregation serve all labels.
    """
    name = None
    for label, condition in labels.items():
        name = F.when(condition, label) if name is None else name.when(condition, label)
    marked = log.select("case_id", name.alias("status"), "ts").filter(F.col("status").isNotNull())
    each = F.when(~F.col("status").isin(list(first_only)), F.col("ts")) if first_only else F.col("ts")
    return marked.groupBy("case_id", "status", each.alias("_each")).agg(F.min("ts").alias("ts")).drop("_each")


def funnel(log: DataFrame) -> DataFrame:
    """Per status: events, distinct cases, and cases whose log starts with it.

    Cases are reduced to one row per (case, status) first, which bounds the distinct count's shuffle.
    """
    per_case = log.groupBy("status", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first")
    )
    return per_case.groupBy("status").agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("cases"),
        F.count(F.when(F.col("first") == 1, 1)).alias("started_with"),
    )


def rounds(log: DataFrame, status: str) -> DataFrame:
    """How many cases had 1, 2, 3 … events of ``status``."""
    per_case = log.filter(F.col("status") == status).groupBy("case_id").agg(F.count(F.lit(1)).alias("round"))
    return per_case.groupBy("round").agg(F.count(F.lit(1)).alias("cases"))
