"""Text helpers: phone numbers, "First Last - ext" strings, labels, NULL-as-blank concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecase.functions.timeid import _col, datediff_boundary


def concat_blank(*cols: Column | str) -> Column:
    """Concatenate, reading NULL as the empty string."""
    return F.concat_ws("", *[_col(c).cast("string") for c in cols])


def normalize_phone(c: Column | str) -> Column:
    """Drop brackets, blanks and dashes."""
    return F.translate(_col(c), "() -", "")


def extension(c: Column | str, width: int = 6) -> Column:
    """The last ``width`` characters without dashes."""
    return F.replace(F.right(_col(c), F.lit(width)), F.lit("-"), F.lit(""))


def parse_user(c: Column | str) -> Column:
    """``"First Last - ext"`` to a struct (first_name, last_name, ext), blanks trimmed."""
    c = _col(c)
    return F.struct(
        F.trim(F.substring_index(c, " ", 1)).alias("first_name"),
        F.trim(F.regexp_extract(c, r"^\S+\s+(.*?)\s*-[^-]*$", 1)).alias("last_name"),
        F.trim(F.substring_index(c, "-", -1)).alias("ext"),
    )


def text_length(c: Column | str) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(_col(c)))


def strip_prefix(c: Column | str, prefix: str) -> Column:
    return F.trim(F.replace(_col(c), F.lit(prefix), F.lit("")))


def is_numeric(c: Column | str) -> Column:
    """Whether a text is a decimal number; ``NaN`` and ``Infinity`` are none."""
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def duration_label(a: Column | str, b: Column | str, none: str = "No start time") -> Column:
    """``"N days"`` above 24 hour boundaries, else ``"h:mm Hours"``; ``none`` when ``a`` is NULL."""
    hours = datediff_boundary("HOUR", a, b)
    minutes = datediff_boundary("MINUTE", a, b)
    days = datediff_boundary("DAY", a, b)
    whole = F.floor(minutes / 60).cast("string")
    rest = F.lpad((minutes % 60).cast("string"), 2, "0")
    return (
        F.when(hours > 24, F.concat(days.cast("string"), F.lit(" days")))
        .when(hours.isNull(), F.lit(none))
        .otherwise(F.concat(whole, F.lit(":"), rest, F.lit(" Hours")))
    )


def contains_ci(c: Column | str, pattern: str) -> Column:
    """LIKE without regard to case, as under a case-insensitive collation."""
    return _col(c).ilike(pattern)
