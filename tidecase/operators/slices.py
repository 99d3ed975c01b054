"""Ordered per-key computations that stay parallel when one key holds much of the data.

A window partitioned by key sends all rows of a key to one task. Here a key with more than
``rows_per_task`` rows is cut into consecutive slices of its order. Rows with their slices are stored once, bucketed and sorted by
(key, slice): the window per (key, slice) and the summaries that cross slice borders (a row count, a last value) both read that
table, without another shuffle or sort. The summaries are one row per slice, accumulated over the slices of the key and joined back.

An input of few bytes holds no such key, and is not looked at: its plan is the plain window. Otherwise hot keys come from a sample
of key and order columns that is stored once; without one, the plan is the plain window too.

A key's rows are cut at sampled quantiles of time first, so crowded times and outliers make no large part; rows drawn by
the same hash serve as further borders, so even many rows at one instant are split when the order has more columns. Both
are sorted arrays in which a row finds its place by halving. Which keys count as hot and where borders lie decides only how rows are
spread, never the result. Where the input is the result of a long pipeline, pass ``hot=hot_keys(narrow columns of
the base log, …)`` to spare computing it for the samples, and to share them between steps.

A rank needs no sorted groups: rows are counted per (key, instant), counts are summed up over the instants of a key, and every
row looks its rank up; rows of a crowded instant are spread over tasks in that join.

Size of what is broadcast: a hot key has about ``rows_per_task`` rows or more, so of N rows about N / rows_per_task
keys at most are hot. They have at most (BORDERS + PARTS) N / rows_per_task slices, each giving one row to the
carried table: for 10^12 rows at the default that is 100,000 keys of PARTS cuts. An array of borders has about
BORDERS / PARTS entries per ``rows_per_task`` rows of its key. Raise ``rows_per_task`` with
the executors' memory to lower it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecase.functions.timeid import clock_number, day_number
from tidecase.sources.scratch import stored, stored_by

ROWS_PER_TASK = 10_000_000
PARTS = 64  # parts of a hot key's time span, cut at quantiles
BORDERS = 8  # further borders per ``rows_per_task`` rows
SAMPLE_ROWS = 10_000  # expected in the sample for a key of ``rows_per_task`` rows
SLICE = "_slice"
#: Stored bytes that a row takes at least, as a rule: an input of fewer bytes for each of ``rows_per_task`` rows has no hot key.
ROW_BYTES = 8


def position(kind: T.DataType, c: Column) -> Column:
    """A number that grows with ``c``, a column of the ordered type ``kind``."""
    if isinstance(kind, T.TimestampNTZType):
        return clock_number("SECOND", c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c).cast("double")
    if isinstance(kind, T.DateType):
        return day_number(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"{kind.simpleString()} has no position in time to slice by")


def same_keys(keys: list[str], prefix: str) -> Column:
    """NULL-safe equality of ``keys`` with their copies named ``prefix`` and a running number."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)])


def copies(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


@dataclass(frozen=True)
class HotKeys:
    """``table``: hot keys with the quantiles of time they are cut at; ``borders``: further borders per (key, part).

    ``found``: whether there are any.
    """

    table: DataFrame
    borders: DataFrame
    found: bool


def input_bytes(df: DataFrame) -> int:
    """Stored size of what ``df`` reads, by Spark's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame, rows_per_task: int) -> bool:
    """Whether ``df`` reads too little to hold ``rows_per_task`` rows of one key."""
    return input_bytes(df) <= rows_per_task * ROW_BYTES


def row_sample(df: DataFrame, every: int) -> DataFrame:
    """One of ``every`` rows, chosen by the hash of the whole row.

    ``df`` should have a row id among its columns, as equal rows are taken or left together.
    """
    return df if every == 1 else df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(every)) == 0)


def order_struct(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])


def passed(items: Column, here: Column, at=lambda item: item) -> Column:
    """How many entries of a sorted array are not after ``here``, by halving: as many steps as the size has bits."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(items) + 1.0)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        up = (s["lo"] < s["hi"]) & (at(F.get(items, mid)) <= here)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def time_part(kind: T.DataType, ts: str) -> Column:
    """Which part of its key's time span a row is in; rows without a time come first, as NULLs do."""
    here = position(kind, F.col(ts))
    return F.when(here.isNull(), -1).otherwise(passed(F.col("_cuts"), here))


def hot_keys(
    df: DataFrame, keys: list[str], order: list[str], rows_per_task: int = ROWS_PER_TASK
) -> HotKeys:
    """Keys with more than about ``rows_per_task`` rows and where to cut them.

    Reads all columns of ``df``, once: select keys, order and a row id before. ``order`` may be the first columns only of
    the order used later.
    """
    ts = order[0]
    kind = df.schema[ts].dataType
    every = max(1, rows_per_task // SAMPLE_ROWS)
    small = is_small(df, rows_per_task)
    if not small:
        df = stored(row_sample(df, every), "sample")
    coarse = every * max(1, rows_per_task // BORDERS // every)  # its rows are in the finer sample too
    drawn = F.pmod(F.xxhash64(*df.columns), F.lit(coarse)) == 0
    times = F.sort_array(F.collect_list(F.when(drawn, position(kind, F.col(ts)))))
    size = F.size("_times")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda i: F.get("_times", F.floor(i * size / PARTS).cast("int")))
    table = (
        row_sample(df, every)
        .groupBy(*keys)
        .agg((F.count(F.lit(1)) * every).alias("_rows"), times.alias("_times"))
        .filter(F.col("_rows") > rows_per_task)
        .select(
            *copies(keys, "_hot"),
            F.array_distinct(F.when(size > PARTS, cuts).otherwise(F.col("_times"))).alias("_cuts"),
            F.ceil(F.col("_rows") * 2 / rows_per_task).cast("int").alias("_parts"),
        )
    )
    borders = (
        row_sample(df, coarse)
        .join(F.broadcast(table), same_keys(keys, "_hot"))
        .groupBy(*copies(keys, "_at"), time_part(kind, ts).alias("_at_part"))
        .agg(F.sort_array(F.collect_list(order_struct([F.col(c) for c in order]))).alias("_borders"))
    )
    if small:
        return HotKeys(table, borders, False)
    table = stored(table, "hot")
    return HotKeys(table, borders, not table.isEmpty())


def heavy_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than about ``rows_per_task`` rows and the number of parts to split them into."""
    every = max(1, rows_per_task // SAMPLE_ROWS)
    return (
        row_sample(df, every)
        .groupBy(*keys)
        .agg((F.count(F.lit(1)) * every).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*copies(keys, "_hot"), F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_parts"))
    )


def with_slice(df: DataFrame, keys: list[str], order: list[str], hot: HotKeys) -> DataFrame:
    """Add the slice number of rows of hot keys, rising with their order; NULL for all other rows."""
    parts = df.join(F.broadcast(hot.table), same_keys(keys, "_hot"), "left").withColumn(
        "_part", F.when(F.col("_cuts").isNotNull(), time_part(df.schema[order[0]].dataType, order[0]))
    )
    # compare as many order columns as the borders and the order have in common
    shared = list(zip(order, hot.borders.schema["_borders"].dataType.elementType.fields))
    here = order_struct([F.col(c).cast(f.dataType) for c, f in shared])
    before = passed(F.col("_borders"), here, lambda border: order_struct([border[f.name] for _, f in shared]))
    at = same_keys(keys, "_at") & (F.col("_part") == F.col("_at_part"))
    return parts.join(F.broadcast(hot.borders), at, "left").select(
        *df.columns,
        (F.col("_part").cast("bigint") * 2**31 + F.when(F.col("_borders").isNotNull(), before).otherwise(0)).alias(SLICE),
    )


def sliced_rows(df: DataFrame, keys: list[str], order: list[str], hot: HotKeys) -> DataFrame:
    """The rows with their slices, stored bucketed and sorted by (key, slice, order)."""
    by = [*keys, SLICE]
    return stored_by(with_slice(df, keys, order, hot), by, [*by, *order])


def directed(columns: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def carry(
    sliced: DataFrame, keys: list[str], summary: Column, over_slices, descending: bool, name: str
) -> DataFrame:
    """Per (hot key, slice): ``over_slices`` applied to ``summary`` of all slices before it."""
    before = (
        Window.partitionBy(*keys)
        .orderBy(*directed([SLICE], descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_slice = (
        sliced.filter(F.col(SLICE).isNotNull()).groupBy(*keys, SLICE).agg(summary.alias("_summary"))
    )
    return per_slice.select(
        *copies(keys, "_carry"),
        F.col(SLICE).alias("_carry_slice"),
        over_slices(F.col("_summary")).over(before).alias(name),
    )


def join_carry(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = same_keys(keys, "_carry") & (F.col(SLICE) == F.col("_carry_slice"))
    return df.join(F.broadcast(carried), on, "left")


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rn",
    descending: bool = False,
    ties: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number the rows of each key: ``row_number``, or ``rank`` with ``ties=True``.

    Give ``order`` a unique last column unless ties are wanted.
    """
    if hot is None:
        # rank orders by time alone, which is no row id
        hot = hot_keys(df if ties else df.select(*keys, *order), keys, order, rows_per_task)
    function = F.rank() if ties else F.row_number()
    if not hot.found:
        plain = Window.partitionBy(*keys).orderBy(*directed(order, descending))
        return df.withColumn(name, function.over(plain).cast("bigint"))
    if ties:
        return _ranked(df, keys, order, name, descending, rows_per_task, hot)
    rows = sliced_rows(df, keys, order, hot)
    window = Window.partitionBy(*keys, SLICE).orderBy(*directed(order, descending))
    local = rows.withColumn("_local", function.over(window))
    offsets = carry(rows, keys, F.count(F.lit(1)), F.sum, descending, "_offset")
    total = (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint")
    return join_carry(local, offsets, keys).select(*df.columns, total.alias(name))


def sums_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, descending: bool, hot: HotKeys
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key before each row, in two levels: within slices, and over slices."""
    rows = sliced_rows(df, keys, order, hot)
    before = Window.partitionBy(*keys, SLICE).orderBy(*directed(order, descending)).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.sum(value).over(before))
    offsets = carry(rows, keys, F.sum(value), F.sum, descending, "_offset")
    total = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_offset"), F.lit(0))
    return join_carry(local, offsets, keys).select(*df.columns, total.alias(name))


def _ranked(
    df: DataFrame, keys: list[str], order: list[str], name: str, descending: bool, rows_per_task: int, hot: HotKeys
) -> DataFrame:
    """Rank from row counts per (key, instant): no rows of a key or instant have to meet in a task."""
    counts = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_n"))
    starts = sums_before(counts, keys, order, "_n", "_before", descending, hot)
    looked_up = spread_lookup(df, starts.drop("_n"), [*keys, *order], rows_per_task)
    return looked_up.select(*df.columns, (F.col("_before") + 1).cast("bigint").alias(name))


def spread_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows with the columns of the one ``lookup`` row of their keys, NULL keys included; rows of heavy keys get a salt."""
    heavy = stored(heavy_keys(df.withColumn("_row", F.monotonically_increasing_id()), keys, rows_per_task), "heavy")
    marked = df.join(F.broadcast(heavy), same_keys(keys, "_hot"), "left")
    salt = F.when(F.col("_parts").isNotNull(), F.floor(F.rand(17) * F.col("_parts"))).otherwise(0).cast("int").alias("_salt")
    facts = stored(marked.select(*df.columns, salt), "salted") if not heavy.isEmpty() else df.withColumn("_salt", F.lit(0))
    repeated = lookup.join(F.broadcast(heavy), same_keys(keys, "_hot"), "left").select(
        *copies(keys, "_look"),
        *[c for c in lookup.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)).alias("_look_salt"),
    )
    return facts.join(repeated, same_keys(keys, "_look") & (F.col("_salt") == F.col("_look_salt")))


def _neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    descending: bool,
    rows_per_task: int,
    hot: HotKeys | None,
) -> DataFrame:
    if hot is None:
        hot = hot_keys(df.select(*keys, *order), keys, order, rows_per_task)
    payload = F.struct(*[F.col(source).alias(out) for out, source in columns.items()])
    if not hot.found:
        plain = Window.partitionBy(*keys).orderBy(*directed(order, descending))
        near = df.withColumn("_near", F.lag(payload).over(plain))
        return near.select(*df.columns, *[F.col("_near." + out).alias(out) for out in columns])
    sliced = sliced_rows(df, keys, order, hot)
    window = Window.partitionBy(*keys, SLICE).orderBy(*directed(order, descending))
    local = sliced.withColumn("_near", F.lag(payload).over(window))
    pick = F.min_by if descending else F.max_by
    borders = carry(
        sliced,
        keys,
        pick(payload, F.struct(*order)),
        lambda c: F.last(c, ignorenulls=True),
        descending,
        "_border",
    )
    joined = join_carry(local, borders, keys).withColumn(
        "_near", F.coalesce(F.col("_near"), F.col("_border"))
    )
    return joined.select(*df.columns, *[F.col("_near." + out).alias(out) for out in columns])


def with_prev(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``{new name: column}`` of the row before, per key."""
    return _neighbour(df, keys, order, columns, False, rows_per_task, hot)


def with_next(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``{new name: column}`` of the row after, per key."""
    return _neighbour(df, keys, order, columns, True, rows_per_task, hot)
