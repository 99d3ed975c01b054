"""Best-fit packing of documents into fixed-length training sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut, so that only their first piece can be shorter than a sequence; full pieces need
no packing. All other pieces are dealt by hash into blocks of about ``BLOCK_ITEMS``, and each block is packed by several islands
at once. An island keeps a small population of packings, which start as best fit in random order, some 1.5 % above the least number of sequences. A child
takes whole well-filled sequences from one parent into a copy of the
other, drops that parent's sequences which hold a piece twice now, and puts the pieces they held besides back by best fit,
longest first, together with those of its ill-filled sequences and of a few others. Between epochs the best packing of each island moves to the next one as a table in the shared folder.
Sequences lost to blocks: less than one half-filled sequence a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.llm.common import table, text_or_empty, tidy, written
from tidecase.llm.tokens import shared_encoder

SEQUENCE_TOKENS = 2048
END_ID = 0
BLOCK_ITEMS = 16_384
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
#: Children of an island and epoch; small blocks, where they cost little, get so many times more.
GENERATIONS = 20
SMALL, MORE = 1_000, 5
#: Shares of its well-filled sequences that one parent hands on and that the other opens besides, drawn for each child.
HANDED_ON = (0.1, 0.5)
OPENED = (0.0, 0.02, 0.1, 0.3, 1.0)
#: A sequence is well filled, and may be handed on whole, from this share of its tokens.
WELL_FILLED = 0.998

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(size: int, end_id: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = shared_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1))):
                ids += tail
                n = len(ids) // 4
                first = n if n <= size else n % size or size
                start = 0
                for piece, end in enumerate(range(first, n + 1, size)):
                    out.append((uid, doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, uid = end, uid + 1
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each document's ids, the end id included; ``uid`` tells rows with the same ``doc_id`` apart."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(tidy(_cut(size, end_id, tokenizer)), _PIECES)


class _BestFit:
    """Sequences by free tokens; finds the fullest one that still takes a piece."""

    def __init__(self, free: np.ndarray):
        self.free = free.tolist()
        self.holding: dict[int, list[int]] = {}
        self.mask = 0
        for b, f in enumerate(self.free):
            self._add(b, f)

    def _add(self, b: int, f: int) -> None:
        if f:
            self.holding.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def put(self, length: int, size: int) -> int:
        fitting = self.mask >> length
        if fitting:
            f = length + (fitting & -fitting).bit_length() - 1
            stack = self.holding[f]
            b = stack.pop()
            if not stack:
                self.mask &= ~(1 << f)
        else:
            b, f = len(self.free), size
            self.free.append(size)
        self.free[b] = f - length
        self._add(b, f - length)
        return b


def _refit(bins: np.ndarray, loose: np.ndarray, lengths: np.ndarray, size: int, order: np.ndarray) -> np.ndarray:
    """``bins`` with the ``loose`` items put back by best fit in the given order, sequences numbered anew."""
    kept, dense = np.unique(bins[~loose], return_inverse=True)
    out = np.empty(len(bins), np.int64)
    out[~loose] = dense
    free = size - np.bincount(dense, lengths[~loose], len(kept)).astype(np.int64)
    fit = _BestFit(free)
    for i in order:
        out[i] = fit.put(int(lengths[i]), size)
    return out


def _falling(items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Items from long to short."""
    return items[np.argsort(-lengths[items], kind="stable")]


def _fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Sequences, then how unevenly they are filled: full and empty ones beside each other leave more room."""
    fill = np.bincount(bins, lengths) / size
    return int(bins.max(initial=-1)) + 1, -float((fill * fill).sum())


def _child(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(b, lengths) / size
    good = np.flatnonzero((fill >= WELL_FILLED) & (rng.random(len(fill)) < rng.choice(HANDED_ON)))
    injected = np.isin(b, good)
    hit = np.zeros(int(a.max(initial=-1)) + 1, bool)
    hit[a[injected]] = True
    # Ill-filled sequences are opened too, so that the displaced pieces find other company.
    hit |= rng.random(len(hit)) < np.where(np.bincount(a, lengths) / size < WELL_FILLED, 1.0, rng.choice(OPENED))
    displaced = hit[a] & ~injected
    bins = np.where(injected, b + len(hit), a)
    return _refit(bins, displaced, lengths, size, _falling(np.flatnonzero(displaced), lengths))


def random_packing(lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit in random order."""
    return _refit(np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool), lengths, size, rng.permutation(len(lengths)))


def evolve(lengths: np.ndarray, population: list[np.ndarray], size: int, seed: int, generations: int = GENERATIONS, members: int = POPULATION) -> list[np.ndarray]:
    """Packings (a sequence number for each item), best first, after some generations from the given ones."""
    return _evolved(lengths, population, size, seed, generations, members)[0]


def _evolved(lengths: np.ndarray, population: list[np.ndarray], size: int, seed: int, generations: int = GENERATIONS, members: int = POPULATION) -> tuple[list[np.ndarray], int, int]:
    """The packings, the sequences that the best had at the start, and how many children were made."""
    rng = np.random.default_rng(seed)
    population = [*population, *(random_packing(lengths, size, rng) for _ in range(members - len(population)))]
    least = -(-int(lengths.sum()) // size)
    ranked = sorted(((_fitness(p, lengths, size), p) for p in population), key=lambda x: x[0])
    first, children = ranked[0][0][0], 0
    generations *= MORE if len(lengths) < SMALL else 1
    while children < generations and ranked[0][0][0] > least:  # no packing has fewer sequences
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = _child(ranked[i][1], ranked[j][1], lengths, size, rng)
        ranked = sorted([*ranked, (_fitness(child, lengths, size), child)], key=lambda x: x[0])[:members]
        children += 1
    return [p for _, p in ranked[:members]], first, children


def _evolve_rows(size: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                start = [np.asarray(p, np.int64) for p in row.population]
                best, first, children = _evolved(lengths, start, size, seed=(row.block * ISLANDS + row.island) * EPOCHS + epoch)
                bins = [p.astype(np.int32) for p in best]
                made = {"sequences": [int(bins[0].max(initial=-1)) + 1], "first": [first], "crossovers": [children]}
                yield pd.DataFrame({"block": [row.block], "island": [row.island], "lengths": [row.lengths], "population": [bins], **made})

    return run


_ISLANDS = "block long, island int, lengths array<int>, population array<array<int>>, sequences int, first int, crossovers int"


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The items of each block with their sequences and their places in them."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            bins, lengths = np.asarray(row.bins, np.int64), np.asarray(row.lengths, np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            first = np.concatenate([[True], np.diff(bins[order]) != 0])
            starts = ends - lengths[order]
            offsets = starts - starts[first][np.cumsum(first) - 1]
            yield pd.DataFrame({"uid": np.asarray(row.uids)[order], "sequence_id": (row.block << 32) + bins[order], "offset": offsets})


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` (a written table with unique ``uid`` and a ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    An empty table gives an empty one. Equal lengths and repeated rows are packed like any others.
    """
    return _placed_pieces(pieces, *packed_islands(pieces, size), size)


def packed_islands(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> tuple[DataFrame, list[DataFrame]]:
    """The blocks of short pieces, and the islands after each epoch: ``sequences`` now and at ``first``, and ``crossovers`` in between."""
    short = pieces.filter(F.col("length") < size).select("uid", F.col("length").cast("int").alias("length"))
    blocks = -(-short.count() // BLOCK_ITEMS) or 1
    # A block's items meet in one row: their number is bounded by the blocks, which are as many as the items need.
    dealt = short.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    dealt = written(dealt.select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")), "blocks")
    none = F.array().cast("array<array<int>>")
    spread = max(1, min(blocks * ISLANDS, 10_000))
    islands = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", none.alias("population"))
    epochs = []
    for epoch in range(EPOCHS):
        if epoch:
            guest = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, 1).alias("guest"))
            islands = islands.join(guest, ["block", "island"]).withColumn("population", F.concat("guest", F.slice("population", 1, POPULATION - 1)))
        islands = islands.select("block", "island", "lengths", "population").repartition(spread, "block", "island")
        islands = written(islands.mapInPandas(tidy(_evolve_rows(size, epoch)), _ISLANDS), f"islands{epoch}")
        epochs.append(islands)
    return dealt, epochs


def _placed_pieces(pieces: DataFrame, dealt: DataFrame, epochs: list[DataFrame], size: int) -> DataFrame:
    best = epochs[-1].groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("sequences", "island")).alias("bins"))
    placed = dealt.join(best, "block").mapInPandas(tidy(_placed), "uid long, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= size)
    return (
        pieces.filter(F.col("length") < size)
        .join(placed, "uid")
        .unionByName(full.withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long")))
    )


def packed_documents(docs: DataFrame, size: int = SEQUENCE_TOKENS, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every token of every document, once, in some sequence.

    A null text counts as empty and is one piece with the end id; a null ``doc_id`` stays null; rows that repeat an id are packed
    apart. Only the id and the text are read, whatever other columns there are.
    """
    return pack(written(token_pieces(docs, size, text, doc_id, end_id, tokenizer), "pieces"), size).drop("uid")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
