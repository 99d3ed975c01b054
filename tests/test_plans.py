"""What the physical plans must and must not contain."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecase.jobs import cohort
from tidecase.operators.events import first_event, last_event, nth_event
from tidecase.operators import slices
from tidecase.operators.intervals import state_on
from tidecase.operators.slices import numbered, with_prev
from tidecase.plans import QUERIES
from tidecase.sources.derived import daily_snapshot
from tidecase.sources.scratch import release_scratch, session_folder
from tidecase.sources.sinks import write_bucketed_table, write_new_table
from tidecase.sources.tables import Tables

# one-row aggregates, date bounds of a calendar, the levels of an interval join
GLOBAL = {
    "global_agg", "calendar_count", "calendar_dim", "dense_grid", "pipeline_size", "business_expiry", "nth_business_day",
    "scalar_subquery", "limit_n", "limit_n_checked", "interval_join", "pipeline_size_window", "snapshot_mondays",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_tables(spark):
    """Plan as for tables too large to broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_crossing_python_or_single_task(spark, data, large_tables, name):
    text = plan(entry.queries()[name](spark, data))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert banned not in text
    if name not in GLOBAL:
        assert "SinglePartition" not in text


def test_first_last_nth_keep_few_rows_before_the_shuffle(spark, data):
    lines = Tables(spark, data).lineitem
    order = ["l_shipdate", "l_linenumber"]
    for df in (
        first_event(lines, ["l_orderkey"], order),
        last_event(lines, ["l_orderkey"], order),
        nth_event(lines, ["l_orderkey"], order, 3),
    ):
        assert re.search(r"Exchange(.|\n)*WindowGroupLimit .*Partial", plan(df))


def test_filters_and_columns_reach_the_scan(spark, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(entry.queries()["filter_and"](spark, data))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("EqualTo(l_returnflag,R)", "EqualTo(l_linestatus,O)", "GreaterThan(l_quantity,45.0)"):
        assert pushed in text
    assert "l_extendedprice" not in text


def test_year_filter_reaches_the_scan(spark, data):
    assert plan(entry.queries()["src_year_union"](spark, data)).count("GreaterThanOrEqual(o_orderdate") == 2


def test_date_id_ranges_reach_the_scan(spark, data):
    for name, column in (("between_dateid", "o_orderdate"), ("state_on_date", "ts")):
        text = plan(entry.queries()[name](spark, data))
        assert f"GreaterThanOrEqual({column}" in text


def test_stored_snapshot_is_pruned_by_day(spark, data, tmp_path):
    snapshot = daily_snapshot(Tables(spark, data).events)
    write_new_table(snapshot, str(tmp_path / "snapshot"), partition_by=["snapshot_id"])
    day = state_on(spark.read.parquet(str(tmp_path / "snapshot")), "snapshot_id", 20240115)
    assert re.search(r"PartitionFilters: \[.*20240115", plan(day))
    assert day.count() == snapshot.filter("snapshot_id = 20240115").count()


def test_bucketed_tables_join_without_shuffle(spark, data, large_tables):
    t = Tables(spark, data)
    write_bucketed_table(t.orders.withColumnRenamed("o_orderkey", "k"), "bucketed_cases", ["k"], 4)
    write_bucketed_table(t.lineitem.withColumnRenamed("l_orderkey", "k"), "bucketed_items", ["k"], 4)
    try:
        df = spark.table("bucketed_cases").join(spark.table("bucketed_items"), "k").groupBy("k").agg(F.count("*"))
        assert "Exchange" not in plan(df)
        assert df.count() == t.lineitem.select("l_orderkey").distinct().count()
    finally:
        spark.sql("DROP TABLE bucketed_cases")
        spark.sql("DROP TABLE bucketed_items")


ROWS = ["event_type"], ["ts", "event_id"]


@pytest.mark.parametrize("make", [
    lambda log: numbered(log, *ROWS, rows_per_task=50),
    lambda log: with_prev(log, *ROWS, {"before": "event_id"}, rows_per_task=50),
])
def test_sliced_rows_are_stored_once_and_read_in_order(spark, data, make):
    """The plan reads the stored slices only, for the rows and for what crosses their borders; the rows are not shuffled or sorted again."""
    df = make(Tables(spark, data).events.select("event_id", "ts", "event_type"))
    text = plan(df)
    assert text.count("FileScan") == 2 and "events.parquet" not in text
    rows = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in rows and " Sort " not in rows
    assert text.count("Exchange hashpartitioning") == 1  # one row per slice


def test_the_log_is_read_once_for_the_sample_and_once_for_the_rows(spark, data, monkeypatch):
    seen = []
    for name in ("stored", "stored_by"):
        real = getattr(slices, name)
        monkeypatch.setattr(slices, name, lambda df, *more, real=real: (seen.append(plan(df).count("events.parquet")), real(df, *more))[1])
    df = numbered(Tables(spark, data).events.select("event_id", "ts", "event_type"), *ROWS, rows_per_task=50)
    assert seen == [1, 0, 1] and "events.parquet" not in plan(df)  # sample, hot keys, sliced rows


def test_a_task_of_the_cohort_report_holds_rows_of_one_step(spark, data, large_tables, monkeypatch):
    """Sorts, windows and joins of the log, of the holds and of the touches are in jobs of their own; what is joined last has one row per case."""
    seen = {}
    real = cohort.stored
    monkeypatch.setattr(cohort, "stored", lambda df, name: (seen.update({name: plan(df)}), real(df, name))[1])
    text = plan(entry.queries()["cohort_wide"](spark, data))
    assert "events.parquet" not in text and "Window" not in text and text.count("SortMergeJoin") == 2
    assert [*seen] == ["cases", "milestones", "holds", "touches"]
    assert seen["holds"].count("events.parquet") == seen["milestones"].count("events.parquet") == 1


def test_small_inputs_keep_the_plain_window(spark, data):
    log = Tables(spark, data).events
    for df in (numbered(log, *ROWS), with_prev(log, *ROWS, {"before": "event_id"}), numbered(log, ["event_type"], ["ts"], ties=True)):
        text = plan(df)
        assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Broadcast" not in text


def test_rank_does_not_bring_the_rows_of_an_instant_together(spark):
    rows = spark.range(6_000).select("id", F.lit("k").alias("key"), F.make_date(F.lit(2024), F.lit(1), (F.col("id") % 2 + 1).cast("int")).alias("day"))
    df = numbered(rows, ["key"], ["day"], "rnk", ties=True, rows_per_task=100)
    assert {tuple(r) for r in df.select("day", "rnk").distinct().collect()} == {(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 3_001)}
    salted = spark.read.parquet(max(glob.glob(f"{session_folder(spark).removeprefix('file:')}/salted-*"), key=os.path.getmtime))
    per_salt = [r["count"] for r in salted.groupBy("day", "_salt").count().collect()]
    assert sum(per_salt) == 6_000 and max(per_salt) < 200
    assert "rank(" not in plan(df)


def test_scratch_is_removed(spark, data):
    folder = session_folder(spark).removeprefix("file:")
    numbered(Tables(spark, data).events, *ROWS, rows_per_task=50).count()
    tables = [r["tableName"] for r in spark.sql("SHOW TABLES").collect()]
    assert os.listdir(folder) and any(n.startswith("tidecase_") for n in tables)
    release_scratch(spark)
    assert not os.path.exists(folder) and not any(r["tableName"].startswith("tidecase_") for r in spark.sql("SHOW TABLES").collect())
    assert numbered(Tables(spark, data).events, *ROWS, rows_per_task=50).count() == Tables(spark, data).events.count()
