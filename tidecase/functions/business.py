"""Business days and business minutes as closed-form Column expressions.

A date maps to the ordinal of the last business day on or before it. Counting, adding and minute
arithmetic are differences of ordinals, so no row ever has to be expanded into days or minutes.

Holidays are dates, or ``(month, day)`` pairs for those that come every year, in whatever year.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecase.functions.timeid import _col, day_number

Holidays = Iterable["dt.date | tuple[int, int]"]
CYCLE = 400  # years after which weekdays and leap years repeat


def _split(holidays: Holidays) -> tuple[list[tuple[int, int]], list[dt.date]]:
    """Yearly holidays, and the single dates that they do not cover."""
    holidays = list(holidays)
    yearly = sorted({h for h in holidays if isinstance(h, tuple)})
    return yearly, sorted({h for h in holidays if not isinstance(h, tuple) and (h.month, h.day) not in yearly})


def is_holiday(c: Column | str, holidays: Holidays) -> Column:
    day = F.to_date(_col(c))
    yearly, single = _split(holidays)
    found = day.isin(single) if single else F.lit(False)
    for month, number in yearly:
        found = found | ((F.month(day) == month) & (F.dayofmonth(day) == number))
    return found


def is_business_day(c: Column | str, holidays: Holidays = ()) -> Column:
    day = F.to_date(_col(c))
    return (F.weekday(day) < 5) & ~is_holiday(day, holidays)


def _passed_years(month: int, number: int) -> list[int]:
    """On how many weekdays a yearly holiday fell in the first 0, 1, … 400 years from 1970 on."""
    passed = [0]
    for year in range(1970, 1970 + CYCLE):
        try:
            passed.append(passed[-1] + (dt.date(year, month, number).weekday() < 5))
        except ValueError:  # 29 February
            passed.append(passed[-1])
    return passed


def _weekday_holidays(day: Column, holidays: Holidays) -> Column | None:
    """Holidays on weekdays up to and including ``day``, from a fixed day on."""
    yearly, single = _split(holidays)
    single = [h for h in single if h.weekday() < 5]
    total = F.size(F.filter(F.array(*[F.lit(h) for h in single]), lambda h: h <= day)) if single else None
    for month, number in yearly:
        passed = _passed_years(month, number)
        table = F.array(*[F.lit(n) for n in passed])
        since = F.year(day) - 1970
        place = F.pmod(since, F.lit(CYCLE))
        before = F.floor(since / CYCLE) * passed[-1] + F.get(table, place)
        this_year = F.when(F.month(day) * 100 + F.dayofmonth(day) >= month * 100 + number, F.get(table, place + 1) - F.get(table, place))
        count = before + F.coalesce(this_year, F.lit(0))
        total = count if total is None else total + count
    return total


def business_ordinal(c: Column | str, holidays: Holidays = ()) -> Column:
    """Business days from Monday 1969-12-29 up to and including ``c``, but for a constant."""
    day = F.to_date(_col(c))
    shifted = day_number(day) + 3
    ordinal = F.floor(shifted / 7) * 5 + F.least(F.weekday(day) + 1, F.lit(5))
    off = _weekday_holidays(day, holidays)
    return (ordinal if off is None else ordinal - off).cast("int")


def business_days(a: Column | str, b: Column | str, holidays: Holidays = ()) -> Column:
    """Business days in the closed range [a, b]; negative or zero when ``b`` is before ``a``."""
    return business_ordinal(b, holidays) - business_ordinal(F.date_sub(F.to_date(_col(a)), 1), holidays)


def business_minutes(
    a: Column | str,
    b: Column | str,
    open_minute: int,
    close_minute: int,
    holidays: Holidays = (),
) -> Column:
    """Minutes of opening time between two timestamps (opening hours as minutes of the day)."""

    def elapsed(c: Column | str) -> Column:
        c = _col(c)
        today = F.least(
            F.greatest(F.hour(c) * 60 + F.minute(c), F.lit(open_minute)), F.lit(close_minute)
        ) - F.lit(open_minute)
        full_days = business_ordinal(F.date_sub(F.to_date(c), 1), holidays)
        worked_today = F.when(is_business_day(c, holidays), today).otherwise(0)
        return full_days * (close_minute - open_minute) + worked_today

    return elapsed(b) - elapsed(a)


def add_business_days(day: Column | str, n: int, holidays: Holidays = ()) -> Column:
    """The ``n``-th business day after ``day``.

    Without holidays the ordinal gives the weekday directly. The weekday holidays up to it are added to the ordinal, which may
    pass further ones; each pass adds all that are new, so as many passes as there are single holidays, and a few for
    the yearly ones, reach the end for any ``n``.
    """
    holidays = list(holidays)

    def weekday_at(ordinal: Column) -> Column:
        return F.date_from_unix_date((F.floor((ordinal - 1) / 5) * 7 + F.pmod(ordinal - 1, F.lit(5)) - 3).cast("int"))

    wanted = business_ordinal(day, holidays) + n
    if not holidays:
        return weekday_at(wanted)
    passes = F.sequence(F.lit(1), F.lit(len(_split(holidays)[1]) + 6))
    return weekday_at(F.aggregate(passes, wanted, lambda x, _: (wanted + _weekday_holidays(weekday_at(x), holidays)).cast("int")))
