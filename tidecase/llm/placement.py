"""Sharding by a permutation-filled lookup table, in DataFrame functions throughout.

Each shard has an order of preference over the slots of a table of prime size: an offset and a step, both hashed from its name.
Shards take turns; at its turn a shard claims the first slot of its order that is still free, until all are taken. Every shard gets
its share of slots to within one turn, and when a shard comes or goes few slots change hands. A row goes to the shard
of the slot that its key hashes to. The table has a fixed number of rows, so it is broadcast, and placement takes one lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.llm.common import table

#: Slots; a prime, over a hundred times the shards, so that shares differ by less than one in a hundred.
SLOTS = 10_007
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def hashed(text: Column, part: int = 0) -> Column:
    """48 bits of the md5 of a text, the first or the second ones."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 12 * part + 1, 12), 16, 10).cast("long")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS, turns: Sequence[int] | None = None) -> DataFrame:
    """``slot, shard, shard_name`` for every slot. ``turns``: indexes of shards in order of turn, one each if not given; a shard listed twice gets twice the slots.

    The fold keeps the table as two bytes a slot. One step looks at one slot: ``len(shards) * slots`` steps are enough for any
    order, and steps after the last slot is taken do nothing.
    """
    if not shards or not _is_prime(slots) or len(shards) > min(slots, 65_535):
        raise ValueError("needs shards, and a prime number of slots that is no less")
    names = F.array(*(F.lit(s) for s in shards))
    order = list(range(len(shards))) if turns is None else list(turns)
    if set(order) != set(range(len(shards))):
        raise ValueError("every shard needs a turn")
    setup = spark.range(1).select(
        F.transform(names, lambda s: hashed(s) % slots).alias("offsets"),
        F.transform(names, lambda s: hashed(s, 1) % (slots - 1) + 1).alias("steps"),
        F.transform(F.sequence(F.lit(0), F.lit(len(shards) - 1)), lambda k: F.unhex(F.lpad(F.hex(k), 4, "0"))).alias("codes"),
        F.array(*(F.lit(k) for k in order)).alias("turns"),
    )
    start = F.struct(
        F.unhex(F.repeat(F.lit("FFFF"), F.lit(slots))).alias("table"), F.array_repeat(F.lit(0).cast("long"), len(shards)).alias("tried"),
        F.lit(0).alias("turn"), F.lit(0).alias("taken"),
    )

    def look(s: Column) -> Column:
        shard = F.get(F.col("turns"), s["turn"])
        tried = F.get(s["tried"], shard)
        slot = ((F.get(F.col("offsets"), shard) + tried * F.get(F.col("steps"), shard)) % slots).cast("int")
        free = F.substring(s["table"], 2 * slot + 1, F.lit(2)) == F.unhex(F.lit("FFFF"))
        return F.struct(
            F.when(free, F.overlay(s["table"], F.get(F.col("codes"), shard), 2 * slot + 1, F.lit(2))).otherwise(s["table"]).alias("table"),
            F.transform(s["tried"], lambda x, k: F.when(k == shard, tried + 1).otherwise(x)).alias("tried"),
            F.when(free, (s["turn"] + 1) % len(order)).otherwise(s["turn"]).alias("turn"),
            F.when(free, s["taken"] + 1).otherwise(s["taken"]).alias("taken"),
        )

    def unless_full(s: Column, then) -> Column:
        return F.when(s["taken"] == slots, s).otherwise(then(s))

    sweep = F.sequence(F.lit(1), F.lit(slots))
    pass_ = lambda s, _: unless_full(s, lambda x: F.aggregate(sweep, x, lambda y, _: unless_full(y, look)))
    filled = setup.select(F.aggregate(F.sequence(F.lit(1), F.lit(len(shards))), start, pass_)["table"].alias("table"))
    rows = filled.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "table")
    shard = F.conv(F.hex(F.substring(F.col("table"), 2 * F.col("slot") + 1, F.lit(2))), 16, 10).cast("int")
    return rows.select("slot", shard.alias("shard")).withColumn("shard_name", F.get(names, F.col("shard")))


def place(rows: DataFrame, key: str, lookup: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` and ``shard_name`` of their key; a null key counts as the empty text. Rows are not shuffled."""
    slot = (hashed(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots).cast("int")
    return rows.withColumn("slot", slot).join(F.broadcast(lookup), "slot")


def sharded(docs: DataFrame, lookup: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, slot, shard, shard_name`` of each row; rows with equal ids go together. Only the id is read, whatever other columns there are."""
    return place(docs.select("doc_id"), "doc_id", lookup, slots).select("doc_id", "slot", "shard", "shard_name")


def permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), lookup_table(spark))


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 3, '0') AS name FROM range({len(SHARDS)}) t(k)),
orders AS (
  SELECT list(('0x' || substr(md5(name), 1, 12))::BIGINT % {SLOTS} ORDER BY k) AS o,
         list(('0x' || substr(md5(name), 13, 12))::BIGINT % {SLOTS - 1} + 1 ORDER BY k) AS s FROM shards),
fill(turn, taken, slot) AS (
  SELECT 0, repeat('0', {SLOTS})::BIT, NULL::BIGINT
  UNION ALL
  SELECT turn + 1, set_bit(taken, next::INTEGER, 1), next FROM (
    SELECT turn, taken, list_filter(list_transform(range({SLOTS}), lambda j: (o[turn % {len(SHARDS)} + 1] + j * s[turn % {len(SHARDS)} + 1]) % {SLOTS}),
                                    lambda x: get_bit(taken, x::INTEGER) = 0)[1] AS next
    FROM fill, orders WHERE turn < {SLOTS})),
lookup AS (SELECT slot::INTEGER AS slot, ((turn - 1) % {len(SHARDS)})::INTEGER AS shard FROM fill WHERE slot IS NOT NULL)
SELECT d.doc_id, l.slot, l.shard, n.name AS shard_name
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents) d
JOIN lookup l ON d.slot = l.slot JOIN shards n ON n.k = l.shard
"""
