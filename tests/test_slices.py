"""Sliced per-key operators against brute force on data where one key holds a third of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecase.operators.events import asof, dwell, first_event, last_event, nth_event
from tidecase.operators.intervals import interval_join, version_join, versions
from tidecase.operators.joins import left_fan_out, spread_join, with_group
from tidecase.operators.slices import hot_keys, numbered, with_next, with_prev, with_slice

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key long, ts timestamp_ntz, state string"
SMALL = 7  # rows per task that force slicing


def skewed(seed: int, rows: int = 400, nulls: bool = True):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        draw = rng.random()
        key = 0 if draw < 0.34 else (None if nulls and draw < 0.5 else rng.randrange(1, 30))
        # an uneven time axis: most events fall on the first day, many at the same second
        hours = rng.choice([0, 0, 0, rng.randrange(0, 5), rng.randrange(0, 600)])
        ts = None if nulls and rng.random() < 0.03 else T0 + dt.timedelta(hours=hours, seconds=rng.randrange(0, 90))
        out.append((i, key, ts, rng.choice("abc")))
    return out


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
    return groups


@pytest.fixture(params=[1, 2, 3])
def rows(request):
    return skewed(request.param)


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_hot_keys_finds_only_large_keys(frame, rows):
    found = {r["_hot0"] for r in hot_keys(frame, ["key"], ["ts"], 50).table.collect()}
    assert found == {k for k, g in by_key(rows).items() if len(g) > 50}
    assert hot_keys(frame, ["key"], ["ts"]).table.count() == 0


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_row_number(frame, rows, limit):
    expected = {r[0]: n for g in by_key(rows).values() for n, r in enumerate(g, 1)}
    got = numbered(frame, ["key"], ["ts", "id"], rows_per_task=limit)
    assert {r["id"]: r["rn"] for r in got.collect()} == expected


def test_row_number_descending(frame, rows):
    expected = {r[0]: n for g in by_key(rows).values() for n, r in enumerate(reversed(g), 1)}
    got = numbered(frame, ["key"], ["ts", "id"], descending=True, rows_per_task=SMALL)
    assert {r["id"]: r["rn"] for r in got.collect()} == expected


def test_rank_with_ties(frame, rows):
    expected = {}
    for group in by_key(rows).values():
        times = [r[2] for r in group]
        expected.update({r[0]: times.index(r[2]) + 1 for r in group})
    got = numbered(frame, ["key"], ["ts"], "rnk", ties=True, rows_per_task=SMALL)
    assert {r["id"]: r["rnk"] for r in got.collect()} == expected


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_neighbours(frame, rows, limit):
    before, after = {}, {}
    for group in by_key(rows).values():
        for a, b in zip(group, group[1:]):
            before[b[0]], after[a[0]] = a[0], b[0]
    order = ["ts", "id"]
    got = with_prev(frame, ["key"], order, {"near": "id"}, rows_per_task=limit).collect()
    assert {r["id"]: r["near"] for r in got} == {r[0]: before.get(r[0]) for r in rows}
    got = with_next(frame, ["key"], order, {"near": "id"}, rows_per_task=limit).collect()
    assert {r["id"]: r["near"] for r in got} == {r[0]: after.get(r[0]) for r in rows}


def test_hot_table_of_another_frame_gives_the_same_result(frame, rows):
    other = hot_keys(frame.filter("ts < '2024-01-01 00:01:00'"), ["key"], ["ts"], 5)
    plain = numbered(frame, ["key"], ["ts", "id"])
    shared = numbered(frame, ["key"], ["ts", "id"], hot=other)
    assert other.table.count() > 0
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, shared.collect()), key=str)


@pytest.mark.parametrize("limit", [SMALL, 10**6])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, frame, rows, direction, strict, limit):
    right_rows = skewed(99)
    right = spark.createDataFrame(right_rows, SCHEMA).repartition(3)
    groups = by_key(right_rows)

    def nearest(row):
        if row[1] is None or row[2] is None:
            return None
        candidates = [r for r in groups.get(row[1], []) if r[2] is not None]
        if direction == "backward":
            fits = [r for r in candidates if r[2] < row[2] or (not strict and r[2] == row[2])]
            return fits[-1][0] if fits else None
        fits = [r for r in candidates if r[2] > row[2] or (not strict and r[2] == row[2])]
        return fits[0][0] if fits else None

    got = asof(
        frame, right, ["key"], "ts", "ts", {"match": "id"},
        direction=direction, strict=strict, ties=["id"], rows_per_task=limit,
    ).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["match"] for r in got} == {r[0]: nearest(r) for r in rows}


def test_asof_inner_keeps_only_matches(spark, frame):
    empty = spark.createDataFrame([], SCHEMA)
    assert asof(frame, empty, ["key"], "ts", "ts", {"m": "id"}, how="inner").count() == 0
    assert asof(frame, empty, ["key"], "ts", "ts", {"m": "id"}).filter("m IS NOT NULL").count() == 0
    assert asof(empty, frame, ["key"], "ts", "ts", {"m": "id"}).count() == 0


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_version_join_matches_interval_logic(spark, rows, limit):
    log = [r for r in skewed(5, nulls=False)]
    seen, clean = set(), []
    for r in log:  # one change per key and instant
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            clean.append(r)
    dim = versions(spark.createDataFrame(clean, SCHEMA), ["key"], ["ts", "id"], ["state"], limit)
    left = spark.createDataFrame(rows, SCHEMA)
    got = version_join(
        left, dim, ["key"], "ts", "valid_from", "valid_to", {"at": "state"}, end_inclusive=False, rows_per_task=limit
    ).collect()
    groups = by_key(clean)
    for r in got:
        known = [g for g in groups.get(r["key"], []) if r["ts"] is not None and g[2] <= r["ts"]]
        assert r["at"] == (known[-1][3] if known and r["key"] is not None else None)


def test_version_join_respects_gaps(spark):
    dim = spark.createDataFrame([(1, 10, 20, "x"), (1, 31, 40, "y")], "key int, a int, b int, v string")
    left = spark.createDataFrame([(1, p) for p in (9, 10, 20, 25, 31, 41)], "key int, p int")
    got = {r["p"]: r["v"] for r in version_join(left, dim, ["key"], "p", "a", "b", {"v": "v"}).collect()}
    assert got == {9: None, 10: "x", 20: "x", 25: None, 31: "y", 41: None}
    inner = version_join(left, dim, ["key"], "p", "a", "b", {"v": "v"}, how="inner")
    assert inner.count() == 3


def test_version_join_prefers_the_open_version_at_one_instant(spark):
    log = spark.createDataFrame([(1, 7, T0, "a"), (2, 7, T0, "b"), (3, 7, T0, "c")], SCHEMA)
    dim = versions(log, ["key"], ["ts", "id"], ["state"])
    left = spark.createDataFrame([(7, T0 + dt.timedelta(hours=n)) for n in (0, 1)], "key long, p timestamp_ntz")
    got = version_join(left, dim, ["key"], "p", "valid_from", "valid_to", {"s": "state"}, end_inclusive=False)
    assert [r["s"] for r in got.collect()] == ["c", "c"]


def test_interval_join_returns_every_overlap_once(spark):
    rng = random.Random(4)

    def moment(span):
        return T0 + dt.timedelta(seconds=rng.randrange(span), microseconds=rng.choice([0, 0, 999]))

    dim_rows = []
    for i in range(200):
        a = moment(40_000)
        length = rng.choice([-5, 0, 1, 3, 4, 15, 16, 17, 600, 3600, 39_999])
        dim_rows.append((rng.choice([0, 0, 1, 2, None]), a, a + dt.timedelta(seconds=length), i))
    left_rows = [(rng.choice([0, 0, 1, 3, None]), moment(45_000), i) for i in range(300)]
    left_rows.append((0, dim_rows[0][1], 300))
    dim = spark.createDataFrame(dim_rows, "key int, a timestamp_ntz, b timestamp_ntz, s int")
    left = spark.createDataFrame(left_rows, "key int, p timestamp_ntz, n int")
    got = interval_join(left, dim, ["key"], "p", "a", F.col("b"), {"s": "s"}).select("n", "s")
    expected = [
        (n, s) for k, p, n in left_rows for k2, a, b, s in dim_rows if k is not None and k == k2 and a <= p <= b
    ]
    assert len(expected) > 100
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert interval_join(left, dim.filter("s < 0"), ["key"], "p", "a", F.col("b"), {"s": "s"}).count() == 0


def test_first_last_nth(frame, rows):
    groups = by_key(rows)
    order = ["ts", "id"]
    assert {r["key"]: r["id"] for r in first_event(frame, ["key"], order).collect()} == {k: g[0][0] for k, g in groups.items()}
    assert {r["key"]: r["id"] for r in last_event(frame, ["key"], order).collect()} == {k: g[-1][0] for k, g in groups.items()}
    assert {r["key"]: r["id"] for r in nth_event(frame, ["key"], order, 4).collect()} == {
        k: g[3][0] for k, g in groups.items() if len(g) > 3
    }


def test_dwell_closes_the_last_interval(spark):
    rows = [(1, 1, T0, "a"), (2, 1, T0 + dt.timedelta(seconds=30), "b"), (3, 1, T0 + dt.timedelta(seconds=50), "a")]
    as_of = F.lit(str(T0 + dt.timedelta(seconds=60))).cast("timestamp_ntz")
    got = dwell(spark.createDataFrame(rows, SCHEMA), ["key"], ["ts", "id"], "state", as_of, rows_per_task=1)
    assert {(r["state"], r["seconds"], r["visits"]) for r in got.collect()} == {("a", 40, 2), ("b", 20, 1)}


def test_with_group_matches_window_and_keeps_null_group(frame, rows):
    groups = by_key(rows)
    got = with_group(frame, ["key"], F.count("*").alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {r[0]: len(groups[r[1]]) for r in rows}


def test_unordered_type_is_refused(frame):
    with pytest.raises(TypeError):
        numbered(frame, ["key"], ["state"]).collect()


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_spread_join_equals_plain_join(spark, frame, limit):
    lookup = spark.createDataFrame([(k, f"name{k}") for k in range(0, 40, 2)], "key long, name string")
    for how in ("inner", "left"):
        plain = frame.join(lookup, "key", how)
        got = spread_join(frame, lookup, ["key"], how, rows_per_task=limit).select(*plain.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_left_fan_out_equals_left_join(spark, frame, limit):
    lookup = spark.createDataFrame([(k, f"name{k}") for k in [None, *range(0, 60, 2)]], "key long, name string")
    plain = lookup.join(frame, "key", "left")
    got = left_fan_out(lookup, frame, ["key"], limit).select(*plain.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_sampled_hot_keys_do_not_depend_on_partitioning(spark):
    rows = spark.range(300_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("key"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 86_400).cast("int"))).alias("ts"),
    )
    limit = 40_000  # one row in four
    found = [
        sorted(map(tuple, hot_keys(rows.repartition(n), ["key"], ["ts", "id"], limit).table.collect())) for n in (2, 7)
    ]
    assert found[0] == found[1]
    assert [r[0] for r in found[0]] == [0]
    assert 10 <= len(found[0][0][1]) <= 30  # about 20 sampled times to cut 100,000 rows at
    assert 4 <= found[0][0][2] <= 6  # 100,000 rows in parts of about 20,000
    window = Window.partitionBy("key").orderBy("ts", "id")
    plain = rows.withColumn("rn", F.row_number().over(window).cast("bigint"))
    assert numbered(rows, ["key"], ["ts", "id"], rows_per_task=limit).exceptAll(plain).count() == 0


def test_an_outlier_does_not_crowd_the_other_rows_into_one_slice(spark):
    rows = spark.range(5_000).select(
        "id", F.lit(1).alias("key"), F.when(F.col("id") == 4_999, F.lit("2199-12-31").cast("timestamp_ntz")).otherwise(
            F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("int"))).alias("ts"),
    )
    hot = hot_keys(rows, ["key"], ["ts", "id"], 400)
    assert max(len(r["_borders"]) for r in hot.borders.collect()) < 20
    sizes = with_slice(rows, ["key"], ["ts", "id"], hot).groupBy("_slice").count().collect()
    assert len(sizes) > 50 and max(r["count"] for r in sizes) < 1000
    assert numbered(rows, ["key"], ["ts", "id"], rows_per_task=400).filter("rn <> id + 1").count() == 0


def test_rows_at_one_instant_are_split_too(spark):
    rows = spark.range(5_000).select("id", F.lit(1).alias("key"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    hot = hot_keys(rows, ["key"], ["ts", "id"], 400)
    sizes = with_slice(rows, ["key"], ["ts", "id"], hot).groupBy("_slice").count().collect()
    assert len(sizes) > 50 and max(r["count"] for r in sizes) < 1000
    got = numbered(rows, ["key"], ["ts", "id"], rows_per_task=400)
    assert got.filter("rn <> id + 1").count() == 0
    near = asof(rows, rows, ["key"], "ts", "ts", {"m": "id"}, strict=False, ties=["id"], rows_per_task=400)
    assert {r["m"] for r in near.select("m").distinct().collect()} == {4_999}
