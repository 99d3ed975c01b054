"""Merkle manifest of a dataset, folded again from changed leaves.

A row's leaf is the SHA-256 of its fields. Per language, leaves in the order of ``doc_id`` are hashed in runs of ``ARITY`` until one node, the
subroot, remains; subroots in the order of the languages are hashed in the same way to the root. Nodes are hashed as lowercase hex text.

A parent is hashed child by child, and a copy of the hash state is kept before each child. To fold a replaced child into the tree the copy
before its slot is resumed with the replacement and the siblings to its right; the siblings to its left are not hashed again.

Work is dealt by blocks of ``ARITY ** BLOCK_LEVELS`` consecutive nodes of a language, whatever share of the rows the language has. A block is a subtree of
fixed height, so a task needs its nodes only; the roots of the blocks are the nodes of the next round, which are so many times fewer. On
the way down each block gets the runs above it, a few kilobytes.

Nulls in any hashed column have a mark of their own and count like values; a null language is a language, ordered first; null ids come first.
Rows with equal language and id are ordered by their leaves, so equal rows may change places without any effect. Texts are hashed whole by
Spark. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecase.llm.common import partitions, table, written

ARITY = 8
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "array<struct<slot:int,run:array<binary>>>"


def _framed(c: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon, and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**replaced: Column) -> Column:
    """The leaf of a row, as bytes, with columns replaced by expressions."""
    return F.unhex(F.sha2(F.concat(*[_framed(replaced.get(c, F.col(c))) for c in FIELDS]), 256))


def changed_here() -> Column:
    """Rows that are tampered with: crc32 of the decimal id is divisible by 3; rows without an id are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


# ---- hashing within a task


def _parent(children: list[bytes]) -> tuple[bytes, list]:
    """The digest of a run, and the hash state before each of its children."""
    h, before = sha256(), []
    for child in children:
        before.append(h.copy())
        h.update(child)
    return h.hexdigest().encode(), before


class Subtree:
    """The levels above consecutive nodes, with the hash states before all children.

    ``levels`` are built, or fewer with ``total`` nodes in the whole tree, as building ends where one node remains.
    """

    def __init__(self, nodes: list[bytes], levels: int, total: int):
        self.rows, self.before = [nodes], []
        for _ in range(levels):
            if total <= 1:
                break
            made = [_parent(self.rows[-1][at : at + ARITY]) for at in range(0, len(self.rows[-1]), ARITY)]
            self.before.append([state for _, states in made for state in states])
            self.rows.append([digest for digest, _ in made])
            total = -(-total // ARITY)
        self.root = self.rows[-1][0]

    def run(self, level: int, node: int) -> list[bytes]:
        first = node - node % ARITY
        return self.rows[level][first : first + ARITY]

    def fold(self, node: int, replacement: bytes) -> bytes:
        """The root with a bottom node replaced."""
        for level, before in enumerate(self.before):
            replacement = _resumed(before[node], replacement, self.run(level, node)[node % ARITY + 1 :])
            node //= ARITY
        return replacement

    def runs(self, node: int) -> list[dict]:
        """Slot and run of a bottom node and its ancestors below the root."""
        out = []
        for level in range(len(self.before)):
            out.append({"slot": node % ARITY, "run": self.run(level, node)})
            node //= ARITY
        return out


def _resumed(state, replacement: bytes, right: list[bytes]) -> bytes:
    h = state.copy()
    h.update(replacement)
    for sibling in right:
        h.update(sibling)
    return h.hexdigest().encode()


class Above:
    """The runs from a block's root to the top, with the state before the slot on the way."""

    def __init__(self, runs: list[dict]):
        self.steps = [(_parent(r["run"][: r["slot"] + 1])[1][-1], r["run"][r["slot"] + 1 :]) for r in runs]
        self.siblings = b"".join(_siblings(r["slot"], r["run"]) for r in runs)

    def fold(self, replacement: bytes) -> bytes:
        for state, right in self.steps:
            replacement = _resumed(state, replacement, right)
        return replacement


def _siblings(slot: int, run: list[bytes]) -> bytes:
    return b"".join(run[:slot] + run[slot + 1 :])


# ---- blocks of nodes


def indexed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, a row's number in its group from 0, and ``n``, the group's size; only borders of sorted parts are gathered.

    Rows are sorted by ranges of (group, order), written, and numbered by the part they are in. The running number as last
    sort column lets equal rows fall into several ranges.
    """
    spark = df.sparkSession
    by = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_any")]
    ranged = df.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop("_any")
    rows = written(ranged.withColumn("_id", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_id", 33))
    parts = rows.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "n": F.sum("_rows").over(whole)})
    idx = (F.col("_id") - F.col("_first") + F.col("_before")).alias("idx")
    return rows.join(parts, [group, "_part"]).select(*df.columns, idx, "n")


def _blocks(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """``g, block, n, nodes``: a block's nodes in order, at most ARITY ** levels of them."""
    own = [c for c in nodes.columns if c not in ("g", "n")]
    block = F.floor(F.col("idx") / ARITY**levels).alias("block")
    return written(nodes.groupBy("g", block, "n").agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in own if c != "idx"]))).alias("nodes")), name)


def _hex(digest: bytes) -> bytes:
    return digest.hex().encode()


def _block_roots(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                root = Subtree([_hex(x["digest"]) for x in r["nodes"]], levels, r["n"]).root
                out.append({"g": r["g"], "idx": r["block"], "n": -(-r["n"] // ARITY**levels), "digest": bytes.fromhex(root.decode())})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("g", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    return run


def _up(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks of a forest with one tree per ``g``, and its roots (``g, digest``)."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, levels, f"merkle-blocks-{len(rounds)}"))
        nodes = written(rounds[-1].select("g", "block", "n", "nodes").mapInArrow(_block_roots(levels), "g string, idx long, n long, digest binary"), f"merkle-roots-{len(rounds)}")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes.select("g", "digest")


def _paths(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.binary()))]))
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                tree = Subtree([_hex(x["digest"]) for x in r["nodes"]], levels, r["n"])
                own = [tree.runs(i) + r["above"] for i in range(len(r["nodes"]))]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"]] * n, pa.string()), pa.array([x["idx"] for x in r["nodes"]], pa.int64()), pa.array(own, kind)], names=["g", "idx", "runs"]
                )

    return run


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The last round's blocks with ``above``, the runs over them; ``tops``: ``g, above`` over each tree's root."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        nodes = blocks.join(above, ["g", "block"]).select("g", "n", "nodes", "above").mapInArrow(_paths(levels), f"g string, idx long, runs {_RUNS}")
        above = nodes.select("g", F.col("idx").alias("block"), F.col("runs").alias("above"))
    return rounds[0].join(above, ["g", "block"])


_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("tampered", pa.bool_())])


def _manifest(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                leaves = [_hex(x["digest"]) for x in r["nodes"]]
                tree, above = Subtree(leaves, levels, r["n"]), Above(r["above"])
                root, subroot = _hex(r["root"]).decode(), _hex(r["subroot"]).decode()
                over: list[bytes] = [above.siblings]  # siblings from a level's nodes to the top, level by level from above
                for level in range(len(tree.before) - 1, -1, -1):
                    over = [_siblings(i % ARITY, tree.run(level, i)) + over[i // ARITY] for i in range(len(tree.rows[level]))]
                out = []
                for i, x in enumerate(r["nodes"]):
                    changed = x["changed"] is not None
                    folded = above.fold(tree.fold(i, _hex(x["changed"]) if changed else leaves[i])).decode()
                    proof = sha256(over[i] if tree.before else above.siblings).hexdigest()
                    out.append((x["doc_id"], leaves[i].decode(), subroot, root, proof, folded, folded == root, changed))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tampered`` of each row of ``docs``.

    ``levels``: height of the subtrees that tasks work on.
    """
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = docs.select(
        F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string"))).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of().alias("digest"),
        F.when(changed_here(), leaf_of(text=lower)).alias("changed"),
    )
    rounds, subroots = _up(indexed(rows, "g", ["doc_id", "digest"], "merkle-leaves"), levels)
    langs = indexed(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest"), "g", ["lang"], "merkle-langs")
    lang_rounds, root = _up(langs, levels)
    none = F.array().cast(_RUNS)
    lang_blocks = _down(lang_rounds, root.select("g", none.alias("above")), levels)
    lang_nodes = lang_blocks.select("g", "n", "nodes", "above").mapInArrow(_paths(levels), f"g string, idx long, runs {_RUNS}")
    nodes = langs.join(lang_nodes, ["g", "idx"]).join(root.withColumnRenamed("digest", "root"), "g")
    tops = nodes.select(F.col("lang").alias("g"), F.col("digest").alias("subroot"), "root", F.col("runs").alias("above"))
    blocks = _down(rounds, tops.select("g", "above"), levels).join(tops.drop("above"), "g")
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tampered boolean"
    return blocks.select("n", "nodes", "above", "subroot", "root").mapInArrow(_manifest(levels), kind)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _run_hash(nodes: str) -> str:
    return f"list_transform(range(0, len({nodes}), {ARITY}), lambda i: sha256(array_to_string({nodes}[i + 1 : i + {ARITY}], '')))"


def _oracle() -> str:
    def framed(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(framed(text if c == "text" else c) for c in FIELDS) + "))"

    step = "list_reduce(list_concat([{x}], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {step.format(x='xor(a, b)')}), 4294967295)"
    at, run = f"(i // {ARITY} * {ARITY})", ARITY

    def climb(prefix: str) -> str:
        """Levels of a node on its way through the lists of nodes."""
        return f"""SELECT c.r, c.g, c.level + 1, c.i // {run},
            sha256(array_to_string(list_concat(l.nodes[{at} + 1 : i], [c.cur], l.nodes[i + 2 : {at} + {run}]), '')),
            c.sibs || array_to_string(list_concat(l.nodes[{at} + 1 : i], l.nodes[i + 2 : {at} + {run}]), '')
            FROM {prefix}c c JOIN {prefix}l l ON l.g = c.g AND l.level = c.level WHERE len(l.nodes) > 1"""

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
l(g, level, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY i) FROM o GROUP BY g
  UNION ALL SELECT g, level + 1, {_run_hash('nodes')} FROM l WHERE len(nodes) > 1),
s AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM l WHERE len(nodes) = 1),
tl(g, level, nodes) AS (
  SELECT '', 0, list(subroot ORDER BY i) FROM s
  UNION ALL SELECT g, level + 1, {_run_hash('nodes')} FROM tl WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM tl WHERE len(nodes) = 1),
c(r, g, level, i, cur, sibs) AS (SELECT r, g, 0, i, coalesce(changed, leaf), '' FROM o UNION ALL {climb('')}),
low AS (SELECT c.r, c.g, c.cur, c.sibs FROM c JOIN l ON l.g = c.g AND l.level = c.level WHERE len(l.nodes) = 1),
tc(r, g, level, i, cur, sibs) AS (SELECT low.r, '', 0, s.i, low.cur, low.sibs FROM low JOIN s ON s.g = low.g UNION ALL {climb('t')}),
high AS (SELECT tc.r, tc.cur, tc.sibs FROM tc JOIN tl ON tl.level = tc.level WHERE len(tl.nodes) = 1)
SELECT o.doc_id, o.leaf, s.subroot, top.root, sha256(high.sibs) AS proof_sha256, high.cur AS folded_root, high.cur = top.root AS verified, o.changed IS NOT NULL AS tampered
FROM o JOIN s ON s.g = o.g JOIN high ON high.r = o.r CROSS JOIN top"""


SQL = _oracle()
