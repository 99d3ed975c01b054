"""Column helpers on hand-made edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecase.functions import business, measures, text, timeid
from tidecase.sources.calendar import calendar

D = dt.datetime


def one(spark, column, **values):
    kinds = {int: "long", str: "string", D: "timestamp_ntz", dt.date: "date", float: "double"}
    names = list(values)
    schema = ", ".join(f"{n} {kinds[type(v)] if v is not None else 'timestamp_ntz'}" for n, v in values.items())
    frame = spark.createDataFrame([tuple(values[n] for n in names)], schema or "x int") if names else spark.range(1)
    return frame.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "unit, a, b, expected",
    [
        ("HOUR", D(2024, 1, 1, 0, 59, 59), D(2024, 1, 1, 1, 0, 0), 1),
        ("MINUTE", D(2024, 1, 1, 0, 0, 59), D(2024, 1, 1, 0, 1, 0), 1),
        ("DAY", D(2024, 1, 1, 23, 59, 59), D(2024, 1, 2, 0, 0, 0), 1),
        ("SECOND", D(2024, 1, 1, 0, 0, 0, 999999), D(2024, 1, 1, 0, 0, 1), 1),
        ("HOUR", D(2024, 1, 1, 1, 0, 0), D(2024, 1, 1, 0, 59, 59), -1),
        ("DAY", D(1969, 12, 31, 12), D(1970, 1, 1, 1), 1),
    ],
)
def test_datediff_counts_boundaries(spark, unit, a, b, expected):
    assert one(spark, timeid.datediff_boundary(unit, "a", "b"), a=a, b=b) == expected


def test_datediff_does_not_depend_on_session_zone(spark):
    column = timeid.datediff_boundary("HOUR", "a", "b")
    spring = dict(a=D(2024, 3, 10, 1, 30), b=D(2024, 3, 10, 3, 30))
    spark.conf.set("spark.sql.session.timeZone", "America/Detroit")
    try:
        assert one(spark, column, **spring) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_and_time_ids(spark):
    at = D(2024, 2, 29, 23, 59, 59)
    assert one(spark, timeid.dateid("a"), a=at) == 20240229
    assert one(spark, timeid.timeid("a"), a=at) == 86400
    assert one(spark, timeid.timeid("a"), a=D(2024, 2, 29)) == 1
    assert one(spark, timeid.ids_to_ts("d", "s"), d=20240229, s=86400) == at
    assert one(spark, timeid.from_dateid("d", strict=False), d=20170100) is None
    with pytest.raises(Exception):
        one(spark, timeid.from_dateid("d"), d=20170100)


@pytest.mark.parametrize("low, high", [(20240100, 20240199), (20231299, 20240215), (20240001, 20241399), (20240229, 20240229)])
def test_dateid_between_matches_int_comparison(spark, low, high):
    days = [dt.date(2023, 11, 1) + dt.timedelta(n) for n in range(500)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    expected = [d for d in days if low <= d.year * 10000 + d.month * 100 + d.day <= high]
    assert sorted(r["d"] for r in frame.filter(timeid.dateid_between("d", low, high)).collect()) == expected


def test_dateadd(spark):
    assert one(spark, timeid.dateadd("YEAR", -1, "a"), a=D(2024, 2, 29, 5)) == D(2023, 2, 28, 5)
    assert one(spark, timeid.dateadd("MONTH", 1, "a"), a=D(2024, 1, 31)) == D(2024, 2, 29)
    assert one(spark, timeid.dateadd("SECOND", 61, "a"), a=D(2024, 1, 1)) == D(2024, 1, 1, 0, 1, 1)


@pytest.mark.parametrize("day, expected", [(1, dt.date(2023, 12, 29)), (7, dt.date(2024, 1, 5)), (6, dt.date(2024, 1, 5)), (3, dt.date(2024, 1, 2))])
def test_prev_business_day(spark, day, expected):
    assert one(spark, timeid.prev_business_day("a"), a=D(2024, 1, day, 8)) == expected


def test_week_of_includes_the_day_itself(spark):
    assert one(spark, timeid.week_of("a", "Fri"), a=D(2024, 1, 5)) == dt.date(2024, 1, 5)
    assert one(spark, timeid.week_of("a", "Fri"), a=D(2024, 1, 4)) == dt.date(2023, 12, 29)


HOLIDAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 15), dt.date(2024, 1, 20)]


def plain_business_days(a, b):
    return sum(
        1 for n in range((b - a).days + 1)
        if (a + dt.timedelta(n)).weekday() < 5 and (a + dt.timedelta(n)) not in HOLIDAYS
    )


def test_business_days_and_expiry_match_counting(spark):
    days = [dt.date(2023, 12, 20) + dt.timedelta(n) for n in range(45)]
    frame = spark.createDataFrame([(a, b) for a in days[::3] for b in days if b >= a], "a date, b date")
    for r in frame.withColumn("n", business.business_days("a", "b", HOLIDAYS)).collect():
        assert r["n"] == plain_business_days(r["a"], r["b"])
    starts = spark.createDataFrame([(d,) for d in days], "a date")
    for n in (1, 10, 500):
        for r in starts.withColumn("x", business.add_business_days("a", n, HOLIDAYS)).collect():
            assert plain_business_days(r["a"] + dt.timedelta(1), r["x"]) == n
            assert r["x"].weekday() < 5 and r["x"] not in HOLIDAYS


@pytest.mark.parametrize("yearly", [(12, 25), (2, 29), (7, 4)])
def test_yearly_holidays_in_any_year(spark, yearly):
    def off(d):
        return d.weekday() >= 5 or (d.month, d.day) == yearly

    starts = [dt.date(y, m, 20) for y in (1899, 1968, 1969, 1970, 2003, 2024, 2399) for m in (2, 6, 12)]
    frame = spark.createDataFrame([(d, d + dt.timedelta(900)) for d in starts], "a date, b date")
    out = frame.select("a", "b", business.business_days("a", "b", [yearly]).alias("n"), business.add_business_days("a", 600, [yearly]).alias("x"))
    for a, b, n, x in out.collect():
        assert n == sum(not off(a + dt.timedelta(k)) for k in range(901))
        assert not off(x) and sum(not off(a + dt.timedelta(k)) for k in range(1, (x - a).days + 1)) == 600


@pytest.mark.parametrize("low, high", [(0, 99991231), (201706099, 201712319), (20170100, 99999999), (19000101, 201706099)])
def test_dateid_bounds_beyond_the_calendar(spark, low, high):
    days = [dt.date(1, 1, 1), dt.date(1900, 1, 1), dt.date(2017, 5, 31), dt.date(2017, 7, 1), dt.date(9999, 12, 31)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    expected = [d for d in days if low <= d.year * 10000 + d.month * 100 + d.day <= high]
    assert sorted(r["d"] for r in frame.filter(timeid.dateid_between("d", low, high)).collect()) == expected


@pytest.mark.parametrize("value, expected", [("NaN", False), ("Infinity", False), ("1e3", True), (" -.5 ", True), ("1d", False), ("", False), (None, False), ("12.", True)])
def test_numbers_in_text(spark, value, expected):
    frame = spark.createDataFrame([(value,)], "a string")
    assert frame.select(text.is_numeric("a")).first()[0] is expected


def test_business_minutes(spark):
    column = business.business_minutes("a", "b", 9 * 60, 17 * 60, HOLIDAYS)
    friday, monday = D(2024, 1, 5, 16, 0), D(2024, 1, 8, 9, 30)
    assert one(spark, column, a=friday, b=monday) == 90
    assert one(spark, column, a=D(2024, 1, 6, 10), b=D(2024, 1, 7, 10)) == 0
    assert one(spark, column, a=D(2024, 1, 12, 9), b=D(2024, 1, 16, 9)) == 480  # Monday 15th is a holiday
    assert one(spark, column, a=D(2024, 1, 3, 7), b=D(2024, 1, 3, 20)) == 480


def test_calendar_flags(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 8)], "date date")
    rows = {r["date"].day: r for r in calendar(days, HOLIDAYS).collect()}
    assert (rows[1]["holiday_flag"], rows[1]["business_flag"]) == (1, 0)
    assert (rows[6]["weekend_flag"], rows[6]["business_flag"]) == (1, 0)
    assert rows[2]["business_flag"] == 1 and rows[7]["weekday_key"] == 1
    assert rows[3]["quarter_key"] == 20241 and rows[3]["day_name"] == "Wednesday"


def test_text_helpers(spark):
    assert one(spark, text.concat_blank("a", F.lit(None), "b"), a="x", b=5) == "x5"
    assert one(spark, text.normalize_phone("a"), a="(313) 555-0199") == "3135550199"
    assert one(spark, text.extension("a"), a="(313) 555-0199") == "50199"
    assert one(spark, text.parse_user("a"), a="Ann  Van Dyke - 5-0199 ").asDict() == {
        "first_name": "Ann", "last_name": "Van Dyke - 5", "ext": "0199",
    }
    assert one(spark, text.parse_user("a"), a="Bo Li-77").asDict() == {"first_name": "Bo", "last_name": "Li", "ext": "77"}
    assert one(spark, text.text_length("a"), a="ab  ") == 2
    assert one(spark, text.is_numeric("a"), a="1.5") is True
    assert one(spark, text.is_numeric("a"), a="x1") is False
    assert one(spark, text.contains_ci("a", "%vendOR%"), a="The Vendor desk") is True


def test_duration_label(spark):
    start = D(2024, 1, 1, 10, 0)
    assert one(spark, text.duration_label("a", "b"), a=start, b=D(2024, 1, 1, 12, 5)) == "2:05 Hours"
    assert one(spark, text.duration_label("a", "b"), a=start, b=D(2024, 1, 3, 10, 0)) == "2 days"
    assert one(spark, text.duration_label("a", "b"), a=None, b=start) == "No start time"


def test_measures(spark):
    frame = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, None), (2, 0.3)], "k int, v double")
    got = frame.agg(
        measures.money_sum("v").alias("s"),
        measures.safe_ratio(measures.count_if(F.col("k") == 9), measures.count_if(F.col("k") == 8)).alias("r"),
        measures.any_flag(F.col("v") > 0.25).alias("any"),
        measures.int_avg("k").alias("avg"),
    ).first()
    assert (got["s"], got["r"], got["any"], got["avg"]) == (0.6, None, "Yes", 1.5)
    assert [r[0] for r in frame.select(measures.flag(F.col("v") > 0.15)).collect()] == [0, 1, 0, 1]
