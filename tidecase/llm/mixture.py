"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget is handed down the tree. At each node it is split among the children by weight; a child that has less than its share
gives all it has, and what it is short of goes to its siblings by their weights. A node's supply is that of its leaves, so a
shortage leaves a branch only when all siblings within it are exhausted. Each leaf then takes a prefix of a token stream:
whole passes (epochs) over its documents, each in an order of its own drawn by a seeded hash, and a part of one more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecase.llm.common import table, text_or_empty, with_row_key, written

LEVELS = ("domain", "lang", "source")
#: Target weights of the query and the pipeline by the name of a node, at every level; 1 for names not listed.
WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"de": 3, "es": 4, "fr": 2}, "source": {"src0": 2, "src3": 5, "src7": 3, "src12": 2}}
SEED = 17
MAX_EPOCHS = 2
#: Share of all documents' tokens that the query asks for.
BUDGET_PERCENT = 80
#: Slots of a leaf's order that are summed up before anything is sorted.
SLOTS = 4096
#: Leaves and slots whose budgets and sums are sent to all tasks.
SENT_LEAVES, SENT_SLOTS = 50_000, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Domain of a source: sources with numbered names go by fives, others are ``other``."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.floor(number.cast("decimal(38,0)") / 5).cast("string")))


def order_number(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the order of an epoch: 48 bits of the md5 of seed, epoch and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def split_budget(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` with ``given``: the parents' ``budget`` split by ``weight``, none above its ``supply``.

    Siblings in order of ``supply / weight``: up to some place all are exhausted, and the others share what is left by weight. That place is the
    first whose share at the common rate is no more than its supply; from there on rates fall, so it has the largest rate of such places.
    """
    order = [F.col("supply") / F.col("weight"), F.col("node")]
    up_to = Window.partitionBy(*parent).orderBy(*order)
    before = F.coalesce(F.sum("supply").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(up_to.rowsBetween(0, Window.unboundedFollowing))
    rated = nodes.withColumn("rate", (F.col("budget") - before) / onward)
    rate = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("supply"), F.col("rate"))).over(Window.partitionBy(*parent))
    rated = rated.withColumn("rate", rate)
    given = F.when(F.col("rate").isNull(), F.col("supply")).otherwise(F.least(F.col("supply"), F.floor(F.col("rate") * F.col("weight"))))
    return rated.withColumn("given", given.cast("long")).drop("rate")


Weights = dict[tuple[str, ...], int] | dict[str, dict[str, int]]


def weight_of(level: str, path: Sequence[str], weights: Weights) -> Column:
    """The weight of a node: by its level and name, or by its whole path; 1 where nothing is said."""
    weight = F.lit(1)
    for key, value in weights.items():
        if key == level:
            for name, number in value.items():
                weight = F.when(F.col(level) == name, F.lit(number)).otherwise(weight)
        elif not isinstance(key, str) and len(key) == len(path):
            same = F.lit(True)
            for column, part in zip(path, key):
                same = same & (F.col(column) == part)
            weight = F.when(same, F.lit(value)).otherwise(weight)
    return weight.cast("long")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Weights | None = None, max_epochs: int = MAX_EPOCHS, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``levels, tokens, given`` of each leaf. ``weights``: whole numbers by level and name or by path from the root; 1 for nodes not named."""
    tree = leaves.withColumn("supply", F.col("tokens") * max_epochs).filter("supply > 0")
    above: DataFrame | None = None
    for depth, level in enumerate(levels, 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = tree.groupBy(*path).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", weight_of(level, path, weights or {})).withColumn("node", F.col(level))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if above is None else nodes.join(above, parent)
        above = split_budget(nodes, parent).select(*path, F.col("given").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "given"), list(levels))


def select_prefixes(docs: DataFrame, budgets: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``docs`` (``doc_id, tokens`` and the levels) with ``epoch`` and ``take``: tokens of it that the leaf's prefix holds in that epoch.

    An epoch that is taken whole needs no order. In the epoch that is cut, a document's place is a hash; slots of places are summed per leaf first, and only
    documents of the slot where the prefix ends are sorted, so a leaf with a third of all rows is not sorted in one task. Budgets of up to ``SENT_LEAVES`` leaves are
    sent to the documents; those of more are joined by shuffle, by leaf and slot wherever rows of a leaf have to come together.
    """
    keys = list(levels)
    given = budgets.select(*keys, F.floor(F.col("given") / F.col("tokens")).alias("whole"), (F.col("given") % F.col("tokens")).alias("rest"))
    given = written(given, "budgets")
    few = given.limit(SENT_LEAVES + 1).count() <= SENT_LEAVES
    own = docs.filter("tokens > 0").join(F.broadcast(given) if few else given, keys)
    width = (1 << 48) // SLOTS
    full = own.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole")))).withColumn("take", F.col("tokens"))
    part = own.filter("rest > 0").withColumn("epoch", F.col("whole") + 1)
    part = part.withColumn("place", order_number(seed, F.col("epoch"), F.col("doc_id"))).withColumn("slot", F.floor(F.col("place") / width).cast("int"))
    sums = part.groupBy(*keys, "slot").agg(F.sum("tokens").alias("slot_tokens"))
    running = F.sum("slot_tokens").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    # Written, so that the join deals both sides by leaf and slot and not by the leaf that the sums were made by.
    sums = written(sums.withColumn("slot_before", F.coalesce(running, F.lit(0))).select(*keys, "slot", "slot_before", "slot_tokens"), "slots")
    part = part.join(F.broadcast(sums) if few and sums.limit(SENT_SLOTS + 1).count() <= SENT_SLOTS else sums, [*keys, "slot"])
    inside = part.filter(F.col("slot_before") + F.col("slot_tokens") <= F.col("rest")).withColumn("take", F.col("tokens"))
    edge = part.filter((F.col("slot_before") < F.col("rest")) & (F.col("slot_before") + F.col("slot_tokens") > F.col("rest")))
    earlier = F.sum("tokens").over(Window.partitionBy(*keys, "slot").orderBy("place", "doc_id", "tokens", "row").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("before", F.col("slot_before") + F.coalesce(earlier, F.lit(0)))
    edge = edge.withColumn("take", F.least("tokens", F.col("rest") - F.col("before"))).filter("take > 0")
    columns = ["doc_id", *keys, "tokens", "row", "epoch", "take"]
    return full.select(*columns).union(inside.select(*columns)).union(edge.select(*columns))


def token_counts(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, row``: tokens are runs of anything but ASCII white space; null names read ``none``.

    ``row``: a column of ``docs`` that tells its rows apart; without one they are numbered.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(name("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("tokens"), (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"))
    return written(rows, "token_counts")


def keep_mixed(docs: DataFrame, percent: int, weights: Weights | None = None) -> DataFrame:
    """The rows of ``docs`` that are in a mix without repetition, the last of each leaf's prefix as a whole; all columns as they are.

    Rows are told apart by a key of their own: null and repeated ids lose or bring no other row. Rows without tokens weigh nothing and stay.
    """
    keyed, key = with_row_key(docs)
    counted = token_counts(keyed, key)
    mixed = mix(counted, percent, weights, max_epochs=1)
    kept = mixed.select("row").union(counted.filter("tokens = 0").select("row")).withColumnRenamed("row", key)
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def mix(counted: DataFrame, percent: int = BUDGET_PERCENT, weights: Weights | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Prefixes that make up ``percent`` of a hundred of all tokens, by the weights.

    ``counted``: as from ``token_counts``. A document without tokens is in no prefix; a null id is ordered as an empty one; repeated
    rows count as often as they occur; an empty table gives an empty one.
    """
    leaves = written(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "leaves")
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0)
    budgets = leaf_budgets(leaves, total * percent // 100, weights, max_epochs)
    return select_prefixes(counted, budgets, seed, max_epochs)


def hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(token_counts(table(spark, sf_dir, "documents")), weights=WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", F.col("epoch").cast("int").alias("epoch"), "tokens", "take")


def _level_sql(name: str, path: list[str], above: str) -> str:
    """Budgets of one level of the tree, in the tables ``name``."""
    cols, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
    match = " AND ".join(f"n.{c} = u.{c}" for c in path[:-1]) or "true"
    named = " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS[path[-1]].items())
    return f"""
{name}_n AS (SELECT {", ".join(f"n.{c}" for c in path)}, n.supply, n.weight, u.budget FROM
  (SELECT {cols}, sum(supply)::BIGINT AS supply, (CASE {path[-1]} {named} ELSE 1 END)::BIGINT AS weight FROM tree GROUP BY {cols}) n JOIN {above} u ON {match}),
{name}_r AS (SELECT *, (budget - coalesce(sum(supply) OVER (PARTITION BY {parent} ORDER BY supply / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / (sum(weight) OVER (PARTITION BY {parent} ORDER BY supply / weight, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS r FROM {name}_n),
{name}_m AS (SELECT *, max(CASE WHEN r * weight <= supply THEN r END) OVER (PARTITION BY {parent}) AS rate FROM {name}_r),
{name} AS (SELECT {cols}, (CASE WHEN rate IS NULL THEN supply ELSE least(supply, floor(rate * weight)::BIGINT) END)::BIGINT AS budget FROM {name}_m)"""


SQL = f"""
WITH counted AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
      ELSE 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT // 5)::VARCHAR END AS domain, lang, source, tokens
  FROM (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
      len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL HAVING sum(tokens) > 0),
tree AS (SELECT *, tokens * {MAX_EPOCHS} AS supply FROM leaves),
root AS (SELECT (sum(tokens)::BIGINT * {BUDGET_PERCENT} // 100)::BIGINT AS budget FROM leaves),
{_level_sql("l1", ["domain"], "root")},
{_level_sql("l2", ["domain", "lang"], "l1")},
{_level_sql("l3", ["domain", "lang", "source"], "l2")},
given AS (SELECT l.domain, l.lang, l.source, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest
  FROM leaves l JOIN l3 b ON l.domain = b.domain AND l.lang = b.lang AND l.source = b.source),
own AS (SELECT c.*, g.whole, g.rest FROM counted c JOIN given g ON c.domain = g.domain AND c.lang = g.lang AND c.source = g.source WHERE c.tokens > 0),
part AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY substr(md5('{SEED}:' || (whole + 1)::VARCHAR || ':' || doc_id::VARCHAR), 1, 12), doc_id) - tokens AS before FROM own WHERE rest > 0)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, tokens, tokens AS take FROM own, LATERAL (SELECT unnest(range(1, whole + 1)) AS e)
UNION ALL
SELECT doc_id, domain, lang, source, (whole + 1)::INTEGER, tokens, least(tokens, rest - before)::BIGINT FROM part WHERE before < rest
"""
