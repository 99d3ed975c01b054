"""Date ids (``yyyymmdd`` ints), time ids (1-based second of the day) and date arithmetic.

Everything is a built-in Column expression. Clock fields are read with ``hour``/``minute``/
``second`` and days with ``to_date``, so TIMESTAMP_NTZ input gives the same answer in every
session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(_col(c)))


def clock_number(unit: str, c: Column | str) -> Column:
    """How many whole ``unit``s of wall-clock time lie between 1970-01-01 and ``c``."""
    c = _col(c)
    days = day_number(c).cast("bigint")
    if unit == "DAY":
        return days
    hours = days * 24 + F.hour(c)
    if unit == "HOUR":
        return hours
    minutes = hours * 60 + F.minute(c)
    if unit == "MINUTE":
        return minutes
    if unit == "SECOND":
        return minutes * 60 + F.second(c)
    raise ValueError(f"unknown unit {unit!r}")


def datediff_boundary(unit: str, a: Column | str, b: Column | str) -> Column:
    """Number of ``unit`` boundaries crossed from ``a`` to ``b`` (00:59:59 to 01:00:00 is one hour)."""
    return clock_number(unit, b) - clock_number(unit, a)


def dateadd(unit: str, n: Column | int, c: Column | str) -> Column:
    """``c`` moved by ``n`` units; YEAR and MONTH clip to the last day of the month."""
    n = F.lit(n) if isinstance(n, int) else n
    c = _col(c)
    if unit == "YEAR":
        return c + F.make_ym_interval(n, F.lit(0))
    if unit == "MONTH":
        return c + F.make_ym_interval(F.lit(0), n)
    parts = {"DAY": "days", "HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}
    return c + F.make_dt_interval(**{parts[unit]: n})


def dateid(c: Column | str) -> Column:
    """Date or timestamp to its ``yyyymmdd`` int."""
    c = _col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def from_dateid(c: Column | str, strict: bool = True) -> Column:
    """``yyyymmdd`` int to a date. ``strict=False`` gives NULL for ids that are no date (20170100)."""
    text = _col(c).cast("string")
    if strict:
        return F.to_date(text, "yyyyMMdd")
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def timeid(c: Column | str) -> Column:
    """Second of the day counted from one."""
    c = _col(c)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c) + 1


def ids_to_ts(date_id: Column | str, time_id: Column | str) -> Column:
    """(date id, 1-based time id) to a TIMESTAMP_NTZ."""
    seconds = (_col(time_id) - 1).cast("int")
    return from_dateid(date_id).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def dateid_between(c: Column | str, low: int, high: int) -> Column:
    """``dateid(c) BETWEEN low AND high``; the bounds need not be dates (20170100).

    The comparison of ids is accompanied by the date range it implies, which Spark can push down to the files.
    """

    def month_start(number: int) -> dt.date:
        number = min(max(number, 12), 12 * 9999 + 11)  # bounds may lie beyond any calendar
        return dt.date(number // 12, number % 12 + 1, 1)

    def month_number(date_id: int) -> int:
        return date_id // 10000 * 12 + min(max(date_id // 100 % 100, 0), 13) - 1

    day = F.to_date(_col(c))
    first, after = month_start(month_number(low)), month_start(month_number(high) + 1)
    within = dateid(c).between(low, high)
    if first > dt.date(1, 1, 1):
        within = (day >= F.lit(first)) & within
    return (day < F.lit(after)) & within if after < dt.date(9999, 12, 1) else within


def at_midnight(text: str) -> Column:
    """A literal TIMESTAMP_NTZ, for pinned ``as_of`` values."""
    return F.lit(text).cast("timestamp_ntz")


def month_name(c: Column | str) -> Column:
    return F.date_format(F.to_date(_col(c)), "MMMM")


def week_of(c: Column | str, weekday: str) -> Column:
    """Latest date that falls on ``weekday`` (``'Mon'`` …) and is not after ``c``."""
    return F.date_sub(F.next_day(F.to_date(_col(c)), weekday), 7)


def prev_business_day(c: Column | str) -> Column:
    """The working day before ``c``, weekends skipped."""
    day = F.to_date(_col(c))
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return F.date_sub(day, back)


def half_hour(c: Column | str) -> Column:
    """Half-hour slot of the day, 0 to 47."""
    c = _col(c)
    return F.hour(c) * 2 + F.floor(F.minute(c) / 30).cast("int")
