"""Stages, result sets, snapshots, kept grids and catalog tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecase.jobs import worklist
from tidecase.jobs.productivity import keep_dashboard
from tidecase.operators import joins
from tidecase.plans import job_queries, join_queries
from tidecase.sources.derived import daily_snapshot
from tidecase.sources.scratch import release_scratch, session_folder
from tidecase.sources.sinks import ResultSet, read_result, result_rows, write_result_sets
from tidecase.sources.snapshots import SnapshotStore
from tidecase.sources.stages import StageStore
from tidecase.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def t(spark, data):
    return Tables(spark, data)


def test_a_stage_is_built_once_for_a_state_of_its_inputs(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)
    store = StageStore(spark, str(tmp_path / "stages"))

    def get():
        df = spark.read.parquet(source)
        return store.get("sums", [df], lambda: (built.append(1), df.agg(F.sum("id").alias("s")))[1])

    assert [get().first()["s"] for _ in range(2)] == [10, 10] and len(built) <= 2
    first = len(built)
    time.sleep(0.05)
    spark.range(5, 7).write.mode("append").parquet(source)
    assert get().first()["s"] == 21 and len(built) > first
    assert len(os.listdir(tmp_path / "stages")) == 2
    assert store.expire(3600) == [] and len(store.expire(-1)) == 2 and os.listdir(tmp_path / "stages") == []


def test_a_failed_stage_leaves_none(spark, data, tmp_path):
    store, df = StageStore(spark, str(tmp_path)), Tables(spark, data).nation
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.get("bad", [df], lambda: df.select((F.lit(1) / (F.col("n_nationkey") - 3)).alias("x")))
    assert all(n.startswith("_") for n in os.listdir(tmp_path))
    assert store.get("bad", [df], lambda: df.select("n_name")).count() == 25


def test_cohort_reports_share_one_stage(spark, data, monkeypatch):
    release_scratch(spark)
    built, real = [], job_queries.cohort_wide
    monkeypatch.setattr(job_queries, "cohort_wide", lambda t: (built.append(1), real(t))[1])
    reports = [entry.queries()[f"cohort_{r}_report"](spark, data) for r in ("speed", "touch", "quality", "profile")]
    assert all(df.count() > 0 and "events.parquet" not in plan(df) for df in reports)
    folder = session_folder(spark).removeprefix("file:")
    assert sum(n.startswith("cohort_wide") for n in os.listdir(f"{folder}/stages")) == 1 and len(built) <= 2
    release_scratch(spark)
    assert not os.path.exists(folder)


def test_result_sets_come_from_one_pass(spark, t, tmp_path):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    sets = {
        "large": ResultSet(F.col("o_totalprice") > 200_000, {"key": F.col("o_orderkey"), "price": F.col("o_totalprice")}, [F.col("price").desc()]),
        "open": ResultSet(F.col("o_orderstatus") == "O", {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus")}, [F.col("key")]),
        "none": ResultSet(F.lit(False), {"key": F.col("o_orderkey")}),
    }
    assert plan(result_rows(base, sets)).count("FileScan") == 1
    layout = write_result_sets(base, sets, str(tmp_path / "out"))
    large, opened, none = (read_result(spark, str(tmp_path / "out"), n, s, layout) for n, s in sets.items())
    assert large.columns == ["key", "price"] and opened.columns == ["key", "status"] and none.count() == 0
    assert [r["price"] for r in large.collect()] == sorted((r[1] for r in base.collect() if r[1] > 200_000), reverse=True)
    assert [r["key"] for r in opened.collect()] == sorted(r[0] for r in base.collect() if r[2] == "O")
    assert "result" in plan(opened).split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError, match="key"):
        result_rows(base, {**sets, "clash": ResultSet(F.lit(True), {"key": F.col("o_orderstatus")})})


def test_the_ten_work_lists_are_written_in_one_job(spark, data, t):
    assert len(job_queries.work_sets()) == 10
    wide = job_queries.work_wide(t)
    assert plan(result_rows(wide, job_queries.work_sets())).count("FileScan") == plan(wide).count("FileScan")
    release_scratch(spark)
    for name in job_queries.WORK_RESULTS:
        text = plan(entry.queries()[f"work_list_{name}"](spark, data))
        assert "lineitem.parquet" not in text and text.count("FileScan") == 1


def test_work_lists_keep_their_order(spark, data):
    got = [(r["days"], r["case_id"]) for r in entry.queries()["work_list_conditions"](spark, data).collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) > 1
    label = [r["suspense"] for r in entry.queries()["work_list_suspense"](spark, data).collect()]
    assert label == sorted(label, reverse=True)


def test_suspense_names_the_review(spark):
    df = spark.createDataFrame([("N", "N"), ("N", "R"), (None, "N"), ("R", None)], "a_status string, b_status string")
    assert [r[0] for r in df.select(worklist.suspended(["a", "b"], "N")).collect()] == ["Both", "a", "b", "No"]


def test_appending_days_equals_rebuilding(spark, t, tmp_path):
    def of(day_id):
        return daily_snapshot(t.events, only_id=day_id)

    whole, daily = SnapshotStore(spark, str(tmp_path / "whole"), of), SnapshotStore(spark, str(tmp_path / "daily"), of)
    whole.rebuild()
    days = sorted(r[0] for r in daily_snapshot(t.events).select("snapshot_id").distinct().collect())
    for day in [*days[:4], days[2]]:
        daily.append(day)
    columns = whole.read().columns
    assert rows(daily.read()) == rows(whole.read().filter(F.col("snapshot_id").isin(days[:4])))
    listed = spark.createDataFrame([(d, d % 2) for d in days], "date_id int, odd int").filter("odd = 1")
    found = whole.on(listed, "date_id").select(columns)
    assert "dynamicpruning" in plan(found)
    assert rows(found) == rows(whole.read().filter("snapshot_id % 2 = 1"))


def test_today_goes_into_the_kept_grid(spark, data, t, tmp_path):
    path = str(tmp_path / "grid")
    full = entry.queries()["productivity_grid"](spark, data)
    last = full.agg(F.max("day")).first()[0]
    keep_dashboard(full.filter(F.col("day") < last).withColumn("online", F.lit(0).cast("bigint")), path)
    before = {n: os.path.getmtime(f"{path}/{n}") for n in os.listdir(path) if n.startswith("day=")}
    for _ in range(2):
        keep_dashboard(job_queries.dashboard(t, historical=False), path)
    kept = spark.read.schema(full.schema).parquet(path)
    assert rows(kept.select(full.columns).filter(F.col("day") == last)) == rows(full.filter(F.col("day") == last)) == rows(entry.queries()["productivity_today"](spark, data))
    assert all(os.path.getmtime(f"{path}/{n}") == m for n, m in before.items()) and kept.count() == full.count()


def test_catalog_tables_have_statistics_and_join_by_buckets(spark, t):
    catalog = join_queries.named_tables(t)
    assert catalog.names() == ["customer", "lineitem", "nation", "orders", "region"]
    assert catalog.orders.count() == t.orders.count()
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {catalog.database}.orders").collect()}
    assert f"{t.orders.count()} rows" in described["Statistics"] and described["Bucket Columns"] == "[`o_orderkey`]"
    assert "distinct_count" in {r[0] for r in spark.sql(f"DESCRIBE EXTENDED {catalog.database}.orders o_custkey").collect()}
    with pytest.raises(AttributeError):
        catalog.nothing
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(job_queries.turn_time_of(catalog))
        assert "hashpartitioning(case_id" not in text and "hashpartitioning(o_orderkey" not in text and "hashpartitioning(l_orderkey" not in text
        assert "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(o_orderkey" not in plan(join_queries.star(catalog))


def test_a_stage_is_built_once(spark, t):
    built = []
    stage = StageStore(spark).get("built_once", [t.nation], lambda: (built.append(1), t.nation.select("n_name"))[1])
    assert stage.count() == 25 and built == [1]


def test_large_lines_of_the_catalog_join_by_buckets_too(spark, t, monkeypatch):
    """As for lines of too many bytes to be taken for small, none of whose cases is heavy."""
    monkeypatch.setattr(joins, "is_small", lambda df, rows_per_task: False)
    catalog = join_queries.named_tables(t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        turned = job_queries.turn_time_of(catalog)
        assert "Exchange hashpartitioning(case_id" not in plan(turned) and "_salt" not in plan(turned) and "SortMergeJoin" in plan(turned)
        assert rows(turned) == rows(job_queries.turn_time_of(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_work_list_stores_lines_of_its_cases_once(spark, t, monkeypatch):
    """Both kinds of review read the stored lines of the listed cases without a shuffle; the conditions read them too."""
    kept = []
    real = worklist.stored_by
    monkeypatch.setattr(worklist, "stored_by", lambda df, *more, **how: (kept.append(real(df, *more, **how)), kept[-1])[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(job_queries.work_wide(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    waiting = t.orders.filter("o_orderstatus = 'O'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    assert [df.count() for df in kept] == [waiting.count()] and 0 < waiting.count() < t.lineitem.count()
    assert "lineitem.parquet" not in text
    for window in text.split("WindowGroupLimit")[1:]:
        assert "Exchange" not in window.split("FileScan")[0]


def test_catalog_goes_with_the_session_folder(spark, t):
    name = join_queries.named_tables(t).database
    assert spark.catalog.databaseExists(name)
    release_scratch(spark)
    assert not spark.catalog.databaseExists(name)
    assert join_queries.named_tables(t).nation.count() == 25


def test_entries_match_by_preferred_names(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    matched = join_queries.resolve_people(join_queries.typed_entries(t), join_queries.staff_list(t))
    text = F.col("user_text")
    found = matched.agg(F.count(F.when(text.like("Nick%"), 1)), F.count(F.when(text.like("% Vand%"), 1)), F.count("*")).first()
    assert found[0] > 10 and found[1] > 10 and found[2] == join_queries.typed_entries(t).count()
