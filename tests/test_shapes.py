"""Joins, subtotals, pivots and grids on edge frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecase.operators.events import first_event, milestones
from tidecase.operators.intervals import current, live, state_on
from tidecase.operators.joins import anti, apply_agg, exists_flag, semi
from tidecase.operators.shapes import dense_grid, fill_grid, pivot_fixed, subtotals, union_padded, unpivot_nonnull
from tidecase.sources.scratch import scratch_path
from tidecase.sources.sinks import write_new_table, write_report, write_results
from tidecase.sources.tables import Tables, read_import


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(1, 10), (1, 20), (None, 30)], "rk int, n int")


def test_count_is_zero_or_null(left, right):
    count = [F.count("*").alias("c")]
    assert rows(apply_agg(left, right, {"k": "rk"}, count, "left", ["c"])) == [(1, "a", 2), (2, "b", 0), (None, "c", 0)]
    assert rows(apply_agg(left, right, {"k": "rk"}, count)) == [(1, "a", 2), (2, "b", None), (None, "c", None)]
    assert rows(apply_agg(left, right, {"k": "rk"}, count, "inner")) == [(1, "a", 2)]


def test_semi_anti_exists(left, right):
    assert rows(semi(left, right, {"k": "rk"})) == [(1, "a")]
    assert rows(anti(left, right, {"k": "rk"})) == [(2, "b"), (None, "c")]
    assert rows(exists_flag(left, right, {"k": "rk"}, "e")) == [(1, "a", 1), (2, "b", 0), (None, "c", 0)]
    null_safe = left.join(right, F.col("k") == F.col("rk"), "left").filter("rk IS NULL").select("k", "v")
    assert rows(anti(left, right, {"k": "rk"})) == rows(null_safe)


def test_subtotals_tell_null_from_total(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", None, 2), (None, "p", 4)], "a string, b string, n int")
    got = subtotals(df, [[], ["a"], ["a", "b"]], [F.sum("n").alias("n")], depth="d")
    assert rows(got.select("a", "b", "n", "d")) == sorted(
        [
            ("All", "All", 7, 2), ("x", "All", 3, 1), ("Unknown", "All", 4, 1),
            ("x", "p", 1, 0), ("x", "Unknown", 2, 0), ("Unknown", "p", 4, 0),
        ],
        key=str,
    )


def test_pivot_equals_hand_pivot_and_missing_is_null(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 5), (2, "z", 9)], "k int, t string, n int")
    pivoted = pivot_fixed(df, ["k"], "t", ["a", "b"], F.sum("n"))
    hand = df.groupBy("k").agg(*[F.sum(F.when(F.col("t") == v, F.col("n"))).alias(v) for v in "ab"])
    assert rows(pivoted) == rows(hand) == [(1, 3, None), (2, None, 5)]


def test_unpivot_drops_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "k int, a string, b string")
    assert rows(unpivot_nonnull(df, ["k"], ["a", "b"], "name", "value")) == [(1, "a", "x")]


def test_dense_grid_keeps_empty_days(spark):
    workers = spark.createDataFrame([(1,), (2,)], "worker int")
    first, last = dt.date(2024, 2, 28), dt.date(2024, 3, 1)
    facts = spark.createDataFrame([(1, dt.date(2024, 2, 29), 7), (3, first, 1)], "worker int, day date, n int")
    grid = fill_grid(dense_grid(workers, F.lit(first), F.lit(last)), [facts], ["worker", "day"])
    assert grid.count() == 6
    assert rows(grid.filter("n IS NOT NULL")) == [(1, dt.date(2024, 2, 29), 7)]


def test_union_pads_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2,)], "k int")
    assert rows(union_padded(a, b)) == [(1, "x"), (2, None)]


def test_union_then_distinct_removes_repeats_across_branches(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(a.union(a).distinct()) == [(1,)]


def test_live_current_state_on(spark):
    df = spark.createDataFrame([(1, 0, 0, 21991231), (2, 1, 0, None), (3, 0, None, 20200101)], "k int, d int, r int, e int")
    assert rows(live(df, "d", "r").select("k")) == [(1,)]
    assert rows(current(df, "e", 21991231).select("k")) == [(1,)]
    assert rows(current(df, "e").select("k")) == [(2,)]
    assert rows(state_on(df, "e", 20200101).select("k")) == [(3,)]


def test_milestones_and_first_event_agree(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 2, "a"), (1, t, 1, "b"), (2, t, 3, "b")], "k int, ts timestamp_ntz, i int, s string")
    marks = milestones(df, ["k"], "ts", {"a": F.col("s") == "a", "b": F.col("s") == "b"})
    assert rows(marks) == [(1, t, t), (2, None, t)]
    assert rows(first_event(df, ["k"], ["ts", "i"]).select("k", "i")) == [(1, 1), (2, 3)]
    assert rows(first_event(df, ["k"], ["ts", "i"], F.col("s") == "a").select("k", "i")) == [(1, 2)]


def test_sinks_refuse_to_overwrite(spark, data, tmp_path):
    region = Tables(spark, data).region
    target = str(tmp_path / "region")
    write_new_table(region, target, partition_by=["r_name"])
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(Exception):
        write_new_table(region, target)
    report = str(tmp_path / "report")
    write_report(region, report)
    assert rows(read_import(spark, report, "k int, name string")) == rows(region)


def test_several_results_from_one_base(spark, data, tmp_path):
    base = Tables(spark, data).nation
    results = {"count": base.agg(F.count("*").alias("n")), "first": base.filter("n_nationkey = 0")}
    write_results(results, base, str(tmp_path))
    assert rows(read_import(spark, str(tmp_path / "count"), "n int")) == [(25,)]


def test_scratch_path_follows_the_session_setting(spark):
    class Shared:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "hdfs://shared/dir/"}.get(key, default)

    assert scratch_path(Shared, "x").startswith("hdfs://shared/dir/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_unknown_table(spark, data):
    with pytest.raises(AttributeError):
        Tables(spark, data).nothing


def test_interval_join_takes_null_ends_as_open(spark):
    from tidecase.operators.intervals import interval_join

    points = spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00") for k in (1, 2) for d in (1, 5, 9)], "k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    spans = [(1, "2024-01-02", "2024-01-05", "a"), (1, "2024-01-04", None, "b"), (2, "2024-01-09", "2024-01-09", "c"), (2, "2020-01-01", "2030-01-01", "d"), (2, "2024-01-08", "2024-01-01", "e")]
    dim = spark.createDataFrame(spans, "k int, a string, b string, name string").withColumn("a", F.col("a").cast("timestamp_ntz")).withColumn("b", F.col("b").cast("timestamp_ntz"))
    found = interval_join(points, dim, ["k"], "t", "a", F.col("b"), {"name": "name"}).select("k", F.dayofmonth("t"), "name")
    assert sorted(map(tuple, found.collect())) == [(1, 5, "a"), (1, 5, "b"), (1, 9, "b"), (2, 1, "d"), (2, 5, "d"), (2, 9, "c"), (2, 9, "d")]
