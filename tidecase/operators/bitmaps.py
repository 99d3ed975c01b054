"""Exact distinct counts over a hierarchy, from bitmaps that merge.

Grouping sets with distinct counts multiply the rows by the sets and by the distinct columns before the shuffle. Here each id sets a bit: rows are shuffled
once, to one bitmap of 32,768 ids per finest group and range of ids, and a level above is the OR of the bitmaps below. Counts
are exact. A bitmap has 4 KB however few of its bits are set, so ids should be dense; ``dense_numbers`` makes them so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecase.sources.scratch import stored


def dense_numbers(values: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct non-NULL values of ``column`` numbered from 0 without gaps, in order.

    Sorted in ranges over all tasks and numbered within each; only the sizes of the ranges come to the driver.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(column).dropna().distinct()
    ranged = distinct.repartitionByRange(parts, column).sortWithinPartitions(column)
    rows = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "dense").withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).orderBy("_part").collect()
    before, bases = 0, []
    for r in sizes:
        bases.append((r["_part"], before - r["_first"]))
        before += r["_n"]
    table = spark.createDataFrame(bases, "_part long, _shift long")
    return rows.join(F.broadcast(table), "_part").select(column, (F.col("_id") + F.col("_shift")).alias(name))


def distinct_rollup(
    df: DataFrame,
    base: Sequence[str],
    levels: Sequence[Sequence[str]],
    distinct: dict[str, str],
    sums: dict[str, Column],
    total_label: str = "All",
    null_label: str = "Unknown",
) -> DataFrame:
    """Distinct counts and sums per ``base`` and per ``base`` with the first 1, 2, … of ``levels``.

    ``distinct``: result name to a column of whole numbers, NULLs not counted; ``sums``: result name to an expression of one row. Columns of
    levels that a row is summed over read ``total_label``, NULLs among the others ``null_label``.
    """
    columns = [c for level in levels for c in level]
    marks = list(distinct)
    kinds = {f.name: f.dataType for f in df.select(*[v.alias(n) for n, v in sums.items()]).schema}

    def entry(i: int, mark: str) -> Column:
        """A row's id of one distinct column; its sums ride with the first."""
        values = [(v if i == 0 else F.lit(None)).cast(kinds[n]).alias(n) for n, v in sums.items()]
        return F.struct(F.lit(i).alias("_kind"), F.col(distinct[mark]).cast("bigint").alias("_id"), *values)

    entries = F.array(*[entry(i, m) for i, m in enumerate(marks)])
    rows = df.select(*base, *columns, F.explode(entries).alias("_e")).select(*base, *columns, "_e.*")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits")
    added = [F.sum(n).alias(n) for n in sums]
    finest = rows.groupBy(*base, *columns, "_kind", F.bitmap_bucket_number("_id").alias("_bucket")).agg(bits, *added)
    level = stored(finest, "bitmaps")
    result: DataFrame | None = None
    for depth in range(len(levels), -1, -1):
        here = [c for group in levels[:depth] for c in group]
        if depth < len(levels):
            level = level.groupBy(*base, *here, "_kind", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), *added)
        counts = [F.sum(F.when(F.col("_kind") == i, F.bitmap_count("_bits"))).alias(m) for i, m in enumerate(marks)]
        counted = level.groupBy(*base, *here).agg(*counts, *added)
        shown = [
            F.coalesce(F.col(c).cast("string"), F.lit(null_label)).alias(c) if c in here else F.lit(total_label).alias(c) for c in columns
        ]
        counted = counted.select(*base, *shown, *marks, *sums)
        result = counted if result is None else result.unionByName(counted)
    return result
