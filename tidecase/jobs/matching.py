"""Match typed-in user names to people, then entries to the nearest earlier clearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecase.functions.text import parse_user
from tidecase.operators.events import asof
from tidecase.operators.joins import with_group


def resolve_people(entries: DataFrame, staff: DataFrame) -> DataFrame:
    """Add ``worker`` to entries whose ``user_text`` ("First Last - ext") fits a person.

    The extension must be equal (an equi join); names are tested on the few people left, without regard to case. The first
    name is the person's or the preferred one; the last name may be cut short, of either last name, but not blank.
    ``staff`` may lack ``preferred_first`` and ``preferred_last``.
    """
    parsed = entries.withColumn("_p", parse_user("user_text"))
    names = {"_first": "first_name", "_last": "last_name", "_first2": "preferred_first", "_last2": "preferred_last"}
    none = F.lit(None).cast("string")
    people = staff.select(
        "worker", F.col("ext").alias("_ext"), *[(F.lower(c) if c in staff.columns else none).alias(a) for a, c in names.items()]
    )
    first, last = F.lower("_p.first_name"), F.lower("_p.last_name")
    fits_first = F.coalesce(F.col("_first") == first, F.lit(False)) | F.coalesce(F.col("_first2") == first, F.lit(False))
    fits_last = F.coalesce(F.contains("_last", last), F.lit(False)) | F.coalesce(F.contains("_last2", last), F.lit(False))
    on = (F.col("_ext") == F.col("_p.ext")) & fits_first & (last != "") & fits_last
    return parsed.join(people, on).drop("_p", "_ext", *names)


def nearest_clearance(entries: DataFrame, clearances: DataFrame) -> DataFrame:
    """Per entry the last clearance of the same loan and worker on the same day, at or before it."""
    left = entries.withColumn("day", F.to_date("ts"))
    right = clearances.withColumn("day", F.to_date("ts"))
    return asof(
        left, right, ["loan", "worker", "day"], "ts", "ts", {"clear_id": "clear_id", "clear_ts": "ts"},
        strict=False, how="inner", ties=["clear_id"],
    ).drop("day")


def match_reasons(clearances: DataFrame, entries: DataFrame, staff: DataFrame) -> DataFrame:
    """Every clearance with the reasons entered for it (blank where none) and the loan's clearance count.

    An entry belongs to the nearest earlier clearance. ``clearances``: clear_id, loan, worker, ts;
    ``entries``: entry_id, loan, ts, user_text, reason; ``staff``: worker, first_name, last_name, ext.
    """
    matched = nearest_clearance(resolve_people(entries, staff), clearances).select("clear_id", "entry_id", "reason")
    counted = with_group(clearances, ["loan"], F.count(F.lit(1)).alias("loan_clearances"))
    return counted.join(matched, "clear_id", "left").select(
        "clear_id",
        "loan",
        "loan_clearances",
        F.col("ts").alias("cleared_at"),
        "entry_id",
        F.coalesce("reason", F.lit(" ")).alias("reason"),
    )
