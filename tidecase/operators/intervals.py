"""Interval joins: the version of a slowly changing dimension that is valid at a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecase.functions.timeid import clock_number
from tidecase.operators.events import asof
from tidecase.operators.slices import ROWS_PER_TASK, HotKeys, hot_keys, sums_before, with_next
from tidecase.sources.scratch import stored


def versions(
    log: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Turn a change log into versions ``[valid_from, valid_to)``; ``valid_to`` is NULL for the last."""
    ts = order[0]
    stepped = with_next(log, keys, order, {"valid_to": ts}, rows_per_task, hot)
    return stepped.select(*keys, *columns, F.col(ts).alias("valid_from"), "valid_to")


def version_join(
    left: DataFrame,
    dim: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    columns: dict[str, str],
    end_inclusive: bool = True,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join each left row to the version with ``start <= point <= end`` (or ``< end``).

    Versions of one key must not overlap, as in a type-2 dimension; a NULL ``end`` is open. Found as
    the last version started at or before the point, then checked against its end: linear in rows, also
    for a key with very many facts and versions. Use ``interval_join`` where intervals overlap.
    """
    # of versions that start at one instant the open or longest one counts
    ranked = dim.withColumn("_reach", F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end")))
    found = asof(
        left, ranked, keys, point, start, {**columns, "_start": start, "_end": end},
        strict=False, ties=["_reach"], rows_per_task=rows_per_task, hot=hot,
    )
    p, e = F.col(point), F.col("_end")
    inside = F.col("_start").isNotNull() & (e.isNull() | ((p <= e) if end_inclusive else (p < e)))
    if how == "inner":
        return found.filter(inside).select(*left.columns, *columns)
    return found.select(
        *left.columns, *[F.when(inside, F.col(out)).alias(out) for out in columns]
    )


def interval_join(
    left: DataFrame,
    dim: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: Column,
    columns: dict[str, str],
) -> DataFrame:
    """Inner join of each left row to every interval with ``start <= point <= end``; overlaps allowed.

    An interval goes to the level whose block width 64**level fits its length, and is listed once per block it touches there,
    that is once or twice however long it is. A point looks up its block at each level that occurs: intervals of
    minutes to a month share two levels. The join is an equi join on (key, level, block) with the exact bounds as a
    residual, so intervals far from the point are never compared with it, and a key with many rows is spread over its
    blocks. A NULL ``end`` is open; use ``sweep_join`` where many are, as open intervals share one block.
    """
    end = F.coalesce(end, F.lit("9999-12-31 23:59:59").cast("timestamp_ntz"))
    first, last = clock_number("SECOND", F.col(start)), clock_number("SECOND", end)
    level = F.ceil(F.log(64.0, (last - first + 1).cast("double"))).cast("int")
    proper = dim.filter(F.col(start) <= end)

    def block(seconds: Column, at: Column) -> Column:
        return F.floor(seconds / F.pow(F.lit(64.0), at)).cast("bigint")

    listed = proper.select(
        *[F.col(k).alias("_i_" + k) for k in keys],
        F.col(start).alias("_start"),
        end.alias("_end"),
        level.alias("_i_level"),
        F.explode(F.sequence(block(first, level), block(last, level))).alias("_i_block"),
        *[F.col(source).alias(out) for out, source in columns.items()],
    )
    levels = proper.agg(F.collect_set(level)).scalar()  # at most 8 numbers, whatever the data
    points = left.select(*left.columns, F.explode(levels).alias("_level")).withColumn(
        "_block", block(clock_number("SECOND", F.col(point)), F.col("_level"))
    )
    on = (F.col("_level") == F.col("_i_level")) & (F.col("_block") == F.col("_i_block"))
    for key in keys:
        on = on & (F.col(key) == F.col("_i_" + key))
    within = (F.col("_start") <= F.col(point)) & (F.col(point) <= F.col("_end"))
    return points.join(listed, on & within).select(*left.columns, *columns)


#: Largest numbers, at which open intervals of numbers end; those of times end with the year 9999.
_LAST = {"int": 2**31 - 1, "bigint": 2**63 - 1, "double": float("inf")}
#: Points of a key between two borders of ``sweep_join``.
SWEEP_POINTS = 256
#: Stretches that are listed together.
RUN = 1024
#: How an aggregate of ``sweep_join`` is made from rows, and from parts of itself.
_MERGES = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def sweep_join(
    left: DataFrame,
    dim: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    columns: dict[str, str],
    points: int = SWEEP_POINTS,
    rows_per_task: int = ROWS_PER_TASK,
    aggs: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Inner join of each left row to every interval with ``start <= point <= end``, of any length, open ones included.

    Points, starts and ends of a key are put in one order, and the points before each are counted, so every point has a number and
    an interval knows the numbers of the first and last point in it. Borders are set at every ``points`` points: an interval is listed once for each
    stretch between borders in which it is alive, so it is compared with less than twice ``points`` points that it does not hold, and listed no more often
    than it has matches. A point is read once and is in one stretch. The join is an equi join on (key, stretch); a hot
    key is spread over its stretches, and its order is taken in slices. Rows with a NULL key, point or start match nothing; a NULL ``end`` is open.

    With ``aggs`` (name to ``count``, ``sum``, ``min`` or ``max`` and an expression over the names in ``columns``) each left row with a match comes once,
    with the aggregates over its matches, and no pairs are made of intervals that are alive throughout a stretch. Such an interval goes to the
    fewest blocks of 1, 2, 4, … stretches that make up what it covers, where it is aggregated; a stretch sums up the blocks that it is in. The rest of an interval, in at most two
    stretches, is aggregated by its first and last point there. Listings are at most two per level of blocks, and pairs at most ``points`` per listing, however many intervals are alive.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    key_of = [F.col(k).alias(n) for k, n in zip(keys, names)]
    facts = left.dropna(subset=[*keys, point])
    spans = dim.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end)))).dropna(subset=keys)
    values = F.struct(*[F.col(source).alias(out) for out, source in columns.items()]).alias("_values")
    numbered_spans = spans.select(*key_of, F.monotonically_increasing_id().alias("_span"), F.col(start).alias("_start"), F.col(end).alias("_end"), values)
    spans = stored(numbered_spans, "spans")  # the numbers must stay when a task is done again
    kind, fact_kind = spans.schema["_start"].dataType, left.schema[point].dataType
    never = F.lit(_LAST.get(kind.simpleString(), "9999-12-31 23:59:59.999999")).cast(kind)
    ends = F.array(
        F.struct(F.col("_start").alias("_ts"), F.lit(0).alias("_side")),
        F.struct(F.coalesce("_end", never).alias("_ts"), F.lit(2).alias("_side")),
    )
    none = F.lit(None).cast(left.schema)
    borders = spans.select(*names, F.explode(ends).alias("_e"), "_span").select(
        *names, "_e._ts", "_e._side", F.col("_span").alias("_tie"), F.lit(0).alias("_one"), none.alias("_left")
    )
    facts = facts.select(
        *key_of, F.col(point).cast(kind).alias("_ts"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_tie"), F.lit(1).alias("_one"), F.struct(*left.columns).alias("_left")
    )
    rows, order = facts.unionByName(borders), ["_ts", "_side", "_tie"]
    hot = hot_keys(rows.drop("_left"), names, order, rows_per_task)
    if hot.found:
        counted = sums_before(rows, names, order, "_one", "_before", False, hot)
    else:
        earlier = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        counted = rows.withColumn("_before", F.coalesce(F.sum("_one").over(earlier), F.lit(0)))
    stretch = lambda n: F.floor(n / points).cast("bigint")
    facts = counted.filter("_side = 1").select(
        *names, stretch(F.col("_before")).alias("_stretch"), F.col("_before").alias("_number"), F.col("_ts").cast(fact_kind).alias("_ts"), "_left"
    )
    first, last = F.min("_before"), F.max("_before") - 1  # numbers of the first and last point from start to end
    alive = counted.filter("_side <> 1").groupBy(F.col("_tie").alias("_span")).agg(first.alias("_first"), last.alias("_last")).filter("_first <= _last")
    if aggs:
        merges = {name: _MERGES[how] for name, (how, _) in aggs.items()}
        values = spans.select("_span", *names, F.col("_end").isNull().alias("_open"), "_values.*").withColumns({f"_agg_{name}": c for name, (_, c) in aggs.items()})
        listed = _alive_in_stretches(stored(values.join(alive, "_span"), "alive"), names, points, merges)
        here = (F.col("_first") <= F.col("_number")) & (F.col("_number") <= F.col("_last"))
        pairs = facts.join(listed, [*names, "_stretch"]).filter(here).select(*names, "_stretch", "_number", "_left.*", *[f"_agg_{name}" for name in aggs])
        # a point has a number of its own, so the other columns only come along
        found = pairs.groupBy(*names, "_stretch", "_number", *left.columns).agg(*[merge(f"_agg_{name}").alias(name) for name, (_, merge) in merges.items()])
        return found.select(*left.columns, *aggs)
    listed = spans.join(alive, "_span").select(
        *names, F.explode(F.sequence(stretch(F.col("_first")), stretch(F.col("_last")))).alias("_stretch"), "_start", "_end", "_values"
    )
    within = (F.col("_start") <= F.col("_ts")) & (F.col("_end").isNull() | (F.col("_ts") <= F.col("_end")))
    return facts.join(listed, [*names, "_stretch"]).filter(within).select("_left.*", *[F.col("_values." + out).alias(out) for out in columns])


def _alive_in_stretches(spans: DataFrame, keys: list[str], points: int, merges: dict[str, tuple]) -> DataFrame:
    """Per (key, stretch): aggregates of the intervals alive from ``_first`` to ``_last`` point of it.

    ``spans``: keys, ``_open``, numbers of the ``_first`` and ``_last`` point, and ``_agg_<name>``, what is aggregated.
    """
    columns = [f"_agg_{name}" for name in merges]
    merged = [merge(c).alias(c) for c, (_, merge) in zip(columns, merges.values())]
    made = [make(c).alias(c) for c, (make, _) in zip(columns, merges.values())]
    first, last, stretch, level = F.col("_first"), F.col("_last"), F.col("_stretch"), F.col("_level")
    # an open interval goes on to the end of its last stretch, behind the last point
    spans = spans.withColumn("_last", F.when(F.col("_open"), (F.floor(last / points) + 1) * points - 1).otherwise(last).cast("bigint"))
    spans = spans.withColumn("_from", F.ceil(first / points).cast("bigint")).withColumn("_to", F.floor((last + 1) / points).cast("bigint"))

    # what is in a stretch, but not all of it
    parts = spans.withColumn("_stretch", F.explode(F.array_distinct(F.array(F.floor(first / points), F.floor(last / points))))).filter(
        (stretch < F.col("_from")) | (stretch >= F.col("_to"))
    )
    low, high = F.greatest(first, stretch * points), F.least(last, stretch * points + points - 1)
    parts = parts.select(*keys, stretch.cast("bigint").alias("_stretch"), low.alias("_first"), high.alias("_last"), *columns)
    parts = parts.groupBy(*keys, "_stretch", "_first", "_last").agg(*made)

    # whole stretches _from .. _to - 1 as blocks: at each level an odd one at either end is listed, the others make up the next level
    def shift(c: Column, by: Column) -> Column:
        return F.call_function("shiftright", c, by)

    def odd_blocks(at: Column) -> Column:
        low, high = -shift(-F.col("_from"), at), shift(F.col("_to"), at)
        ends = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
        return F.transform(F.array_compact(ends), lambda b: F.struct(at.alias("_level"), b.alias("_block")))

    length = F.col("_to") - F.col("_from")
    levels = F.sequence(F.lit(0), F.floor(F.log2(length.cast("double"))).cast("int") + 1)
    blocks = spans.filter(length > 0).withColumn("_b", F.explode(F.flatten(F.transform(levels, odd_blocks))))
    blocks = stored(blocks.select(*keys, "_b.*", *columns).groupBy(*keys, "_level", "_block").agg(*made), "blocks")
    # a stretch looks up its block at each level that occurs; stretches are listed from runs of them, so that no task lists all of a key
    highest = F.lit(blocks.agg(F.max("_level")).first()[0] or 0)
    begin, end = (F.call_function("shiftleft", c, level) for c in (F.col("_block"), F.col("_block") + 1))
    reach = blocks.groupBy(*keys).agg(F.floor(F.min(begin) / RUN).cast("bigint").alias("_low"), F.floor((F.max(end) - 1) / RUN).cast("bigint").alias("_high"))
    runs = reach.select(*keys, F.explode(F.sequence("_low", "_high")).alias("_run")).repartition(*keys, "_run")
    stretches = runs.select(*keys, F.explode(F.sequence(F.col("_run") * RUN, F.col("_run") * RUN + RUN - 1)).alias("_stretch"))
    looked_up = stretches.select(*keys, "_stretch", F.explode(F.sequence(F.lit(0), highest)).alias("_level")).withColumn("_block", shift(stretch, level))
    whole = looked_up.join(blocks, [*keys, "_level", "_block"]).groupBy(*keys, "_stretch").agg(*merged)
    whole = whole.select(*keys, "_stretch", (stretch * points).alias("_first"), (stretch * points + points - 1).alias("_last"), *columns)
    return parts.unionByName(whole)


def state_on(snapshot: DataFrame, date_column: str, date_id: int | Column) -> DataFrame:
    """Rows of a daily snapshot on one day; prunes partitions when stored by that column."""
    return snapshot.filter(F.col(date_column) == date_id)


def live(df: DataFrame, *flags: str) -> DataFrame:
    """Rows where every delete / reverse / rollback flag is 0."""
    for name in flags:
        df = df.filter(F.col(name) == 0)
    return df


def current(df: DataFrame, end_column: str, sentinel: int | None = None) -> DataFrame:
    """Current versions: the end is the sentinel, or NULL when there is none."""
    if sentinel is None:
        return df.filter(F.col(end_column).isNull())
    return df.filter(F.col(end_column) == sentinel)
