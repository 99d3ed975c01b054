"""Bitmap rollups, sweeps over open intervals and leader chains against brute force."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidecase.jobs import people
from tidecase.operators.bitmaps import dense_numbers, distinct_rollup
from tidecase.operators.intervals import sweep_join
from tidecase.sources.scratch import session_folder

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_over_levels(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice("pq"), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, *range(-5, 70_000, 977)]), rng.randrange(40), i)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "pilot string, team string, title string, case_id long, worker int, seconds long").repartition(4)
    out = distinct_rollup(df, ["pilot"], [["team"], ["title"]], {"cases": "case_id", "workers": "worker"}, {"seconds": F.col("seconds")})
    got = {tuple(r[:3]): tuple(r[3:]) for r in out.select("pilot", "team", "title", "cases", "workers", "seconds").collect()}
    expected = {}
    for depth in range(3):
        for row in rows:
            key = (row[0], *[("Unknown" if v is None else v) if i < depth else "All" for i, v in enumerate(row[1:3])])
            cases, workers, total = expected.setdefault(key, (set(), set(), []))
            cases |= {row[3]} - {None}
            workers.add(row[4])
            total.append(row[5])
    assert got == {k: (len(c), len(w), sum(s)) for k, (c, w, s) in expected.items()}
    assert "Expand" not in plan(out)


def test_rows_are_shuffled_to_bitmaps_once(spark, monkeypatch):
    from tidecase.operators import bitmaps

    seen = []
    monkeypatch.setattr(bitmaps, "stored", lambda df, name: (seen.append(plan(df).count("Exchange hashpartitioning")), df)[1])
    rows = spark.createDataFrame([("p", "a", 1)], "pilot string, team string, case_id long")
    distinct_rollup(rows, ["pilot"], [["team"]], {"cases": "case_id"}, {"n": F.lit(1)})
    assert seen == [1]


def test_dense_numbers(spark):
    values = [f"id{i * 37 % 1000}" for i in range(3000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "name string").repartition(7)
    got = {r["name"]: r["n"] for r in dense_numbers(df, "name", "n").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    assert dense_numbers(df.filter("name = 'none'"), "name", "n").count() == 0


@pytest.mark.parametrize("limit, points", [(7, 4), (10**6, 4), (10**6, 256)])
def test_sweep_finds_every_overlap_once(spark, limit, points):
    rng = random.Random(8)

    def moment(span):
        return T0 + dt.timedelta(seconds=rng.randrange(span))

    dim_rows = []
    for i in range(150):
        a = moment(4_000)
        length = rng.choice([-5, 0, 1, 60, 600, 3_999, None, None])
        dim_rows.append((rng.choice([0, 0, 1, 2, None]), None if i % 50 == 7 else a, None if length is None else a + dt.timedelta(seconds=length), i))
    left_rows = [(rng.choice([0, 0, 1, 3, None]), moment(4_500), i) for i in range(200)] + [(0, None, 200), (0, T0, 201), (0, T0, 201)]
    left_rows += [(0, dim_rows[0][1], 300), (1, dim_rows[1][2] or T0, 301)]
    dim = spark.createDataFrame(dim_rows, "key int, a timestamp_ntz, b timestamp_ntz, s int")
    left = spark.createDataFrame(left_rows, "key int, p timestamp_ntz, n int")
    got = sweep_join(left, dim, ["key"], "p", "a", "b", {"s": "s"}, points=points, rows_per_task=limit)
    expected = [
        (n, s) for k, p, n in left_rows for k2, a, b, s in dim_rows
        if k is not None and k == k2 and p is not None and a is not None and a <= p and (b is None or p <= b)
    ]
    assert len(expected) > 1000 and got.columns == ["key", "p", "n", "s"]
    assert sorted((r["n"], r["s"]) for r in got.collect()) == sorted(expected)
    assert sweep_join(left, dim.filter("s < 0"), ["key"], "p", "a", "b", {"s": "s"}).count() == 0


def test_sweep_on_whole_numbers(spark):
    dim = spark.createDataFrame([(1, 5, "x"), (3, None, "y"), (9, 8, "z")], "a int, b int, s string").withColumn("k", F.lit(1))
    left = spark.createDataFrame([(p,) for p in range(8)], "p int").withColumn("k", F.lit(1))
    got = sorted((r["p"], r["s"]) for r in sweep_join(left, dim, ["k"], "p", "a", "b", {"s": "s"}, points=2).collect())
    assert got == sorted([(p, "x") for p in range(1, 6)] + [(p, "y") for p in range(3, 8)])


def test_open_intervals_and_points_of_a_hot_key_are_spread(spark):
    """All points and a thousand open intervals have one key; the points are read from one stored table, once for themselves."""
    second = lambda c: F.make_dt_interval(secs=c.cast("int"))
    points = spark.range(4_000).select(F.lit(1).alias("k"), "id", (F.lit("2024-01-01").cast("timestamp_ntz") + second(F.col("id"))).alias("p"))
    start = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz") + second(F.col("id") % 60)
    open_ones = spark.range(1_000).select(F.lit(1).alias("k"), F.col("id").alias("s"), start.alias("a"), F.lit(None).cast("timestamp_ntz").alias("b"))
    got = sweep_join(points, open_ones, ["k"], "p", "a", "b", {"s": "s"}, points=50, rows_per_task=500)
    assert got.count() == sum(sum(1 for s in range(1_000) if 3600 + s % 60 <= i) for i in range(3_600, 4_000))
    assert plan(got).count("_left#") > 0 and "Range" not in plan(got) and re.search(r"SortMergeJoin \[_key0#\d+, _stretch|BroadcastHashJoin \[_key0#\d+, _stretch", plan(got))


@pytest.mark.parametrize("limit, points", [(7, 1), (7, 4), (10**6, 3), (10**6, 256)])
def test_sweep_aggregates_as_over_its_pairs(spark, limit, points):
    rng = random.Random(9)
    dim_rows = []
    for i in range(300):
        a = rng.choice([None, *range(600)]) if i % 60 == 7 else rng.randrange(600)
        dim_rows.append((rng.choice([0, 0, 1, 2, None]), a, None if a is None or i % 6 == 0 else a + rng.choice([-3, 0, 1, 9, 80, 400, 10**6]), rng.choice([None, i])))
    left_rows = [(rng.choice([0, 0, 1, 3, None]), rng.choice([None, *range(650)]) if i % 50 == 0 else rng.randrange(650), i) for i in range(400)] + [(0, 300, 5), (0, 300, 5)] + [(1, 7, None)] * 40
    dim = spark.createDataFrame(dim_rows, "key int, a int, b int, s int")
    left = spark.createDataFrame(left_rows, "key int, p int, n int")
    aggs = {"alive": ("count", F.lit(1)), "least": ("min", F.col("s")), "most": ("max", F.col("s")), "total": ("sum", F.col("s"))}
    got = sweep_join(left, dim, ["key"], "p", "a", "b", {"s": "s"}, points=points, rows_per_task=limit, aggs=aggs)
    expected = []
    for k, p, n in left_rows:
        here = [s for k2, a, b, s in dim_rows if None not in (k, p, a) and k == k2 and a <= p and (b is None or p <= b)]
        known = [s for s in here if s is not None]
        if here:
            expected.append((k, p, n, len(here), min(known, default=None), max(known, default=None), sum(known) if known else None))
    assert len(expected) > 200 and got.columns == ["key", "p", "n", *aggs]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))


def test_aggregated_open_intervals_are_not_listed_in_every_stretch(spark):
    """A thousand intervals that are alive to the end, and one point a second: what meets the points does not grow with intervals times stretches."""
    listed = []
    for n in (1_000, 4_000):
        points = spark.range(n).select(F.lit(1).alias("k"), "id", F.col("id").alias("p"))
        open_ones = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"))
        counted = sweep_join(points, open_ones, ["k"], "p", "a", "b", {"s": "s"}, points=10, rows_per_task=500, aggs={"alive": ("count", F.lit(1))})
        assert counted.agg(F.sum("alive")).first()[0] == n * (n + 1) // 2
        folder = session_folder(spark).removeprefix("file:")
        newest = max((f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("blocks-")), key=os.path.getmtime)
        listed.append(spark.read.parquet(newest).count())
    assert listed[1] < 6 * listed[0] and listed[1] < 1_000


def leaders(rows):
    up = dict(rows)
    out = {}
    for person in up:
        at, levels, seen = person, 0, set()
        while up[at] in up and at not in seen:
            seen.add(at)
            at, levels = up[at], levels + 1
        out[person] = (None, None) if at in seen else (at, levels)
    return out


@pytest.mark.parametrize("rows", [
    [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2003), (2001, 2000), (2002, 2001), (2003, 2002), (2004, 2003), (3000, 3000), (4000, 9999), (4001, 4000)],
    [(i, random.Random(i).randrange(i) if i else None) for i in range(300)],
    [(1, 2), (2, 1)],
    [(1, None)],
])
def test_top_leaders(spark, rows, monkeypatch):
    jumps = []
    real = people._jump
    monkeypatch.setattr(people, "_jump", lambda state: (jumps.append(1), real(state))[1])
    df = spark.createDataFrame(rows, "id long, leader long")
    got = {r["id"]: (r["top_leader"], r["levels"]) for r in people.top_leaders(df).collect()}
    assert got == leaders(rows) and len(jumps) <= 12
    assert people.top_leaders(df.filter("id < 0")).count() == 0
