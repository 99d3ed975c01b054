"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is taken relative to the mean, turned by a random rotation into ``BITS`` dimensions (with more bits than
dimensions it is padded with zeros first), and kept as the signs, packed, with a few scalars: its length, its
inner product with the mean, and ``<code, unit vector>``, by which an estimate from the signs is corrected. The estimate's error
is bounded, with a chance set by ``SIGMAS``, by ``sqrt((1 - f^2) / f^2) * SIGMAS / sqrt(BITS - 1)`` for the correction scalar ``f``. Within a block,
vectors whose upper bound reaches the k-th largest lower bound are reranked with the stored vectors in double precision.

Codes lie in block rows, and the queries in block rows as well; each block of queries meets each block of codes once. The pair of
blocks gives ``k`` rows a query, so nothing gathers more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecase.llm.common import partitions, table, written

BITS = 256
SIGMAS = 1.9
BLOCK_VECTORS = 4_096
BLOCK_QUERIES = 1_024
NEAREST = 20


def rotation(dimensions: int, bits: int, seed: int = 11) -> np.ndarray:
    """``dimensions`` orthonormal columns of a random rotation of ``bits`` dimensions (bits x dimensions)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimensions)))
    return q * np.sign(np.diag(r))


def code_bits(dimensions: int) -> int:
    """Bits a code has: ``BITS``, or the next multiple of 8 that is no less than the dimensions."""
    return max(BITS, -(-dimensions // 8) * 8)


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Packed signs, lengths relative to the mean, correction scalars, and inner products with the mean."""
    apart = vectors - mean
    length = np.sqrt((apart * apart).sum(1))
    unit = (apart / np.where(length > 0, length, 1)[:, None]) @ turn.T
    signs = unit > 0
    factor = np.abs(unit).sum(1) / np.sqrt(turn.shape[0])
    return np.packbits(signs, axis=1), length, np.where(length > 0, factor, 1.0), vectors @ mean


def estimates(codes: tuple[np.ndarray, ...], queries: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) from the codes, and how far they can be off."""
    packed, length, factor, with_mean = codes
    bits = turn.shape[0]
    signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
    apart = queries - mean
    size = np.sqrt((apart * apart).sum(1))
    turned = ((apart @ turn.T) / np.sqrt(bits)).astype(np.float32)
    # <x, q> = <x - m, q - m> + <x, m> + <m, q> - <m, m>
    middle = (turned @ signs.T) * (length / factor)[None, :]
    guess = middle + with_mean[None, :] + (queries @ mean - mean @ mean)[:, None]
    off = np.sqrt(np.maximum(1 - factor * factor, 0)) / factor * (SIGMAS / np.sqrt(bits - 1)) * length
    return guess, off[None, :] * size[:, None]


def search(ids: np.ndarray, vectors: np.ndarray, codes: tuple, query_ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, ids, inner products) of the ``k`` nearest in the block for each query, reranked among those the bounds leave."""
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        guess, off = estimates(codes, some, mean, turn)
        for i in range(len(some)):
            other = np.flatnonzero(ids != query_ids[at + i])
            if not len(other):
                continue
            lower = (guess[i] - off[i])[other]
            least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
            chosen = other[(guess[i] + off[i])[other] >= least]
            exact = (vectors[chosen] * some[i]).sum(1)
            best = np.lexsort((ids[chosen], -exact))[:k]
            yield query_ids[at + i], ids[chosen][best], exact[best]


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    vectors = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
    return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})


_BLOCK = "dims int, block long, ids binary, vectors binary"
_CODED = _BLOCK + ", codes binary, scalars binary"


def _encode_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        codes, scalars = [], []
        for row in batch.itertuples(index=False):
            turn = rotation(row.dims, code_bits(row.dims))
            packed, *rest = encode(np.frombuffer(row.vectors).reshape(-1, row.dims), np.asarray(row.mean, np.float64), turn)
            codes.append(packed.tobytes())
            scalars.append(np.stack(rest).tobytes())
        yield batch.assign(codes=codes, scalars=scalars)[["dims", "block", "ids", "vectors", "codes", "scalars"]]


def _search_blocks(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                turn = turns.get(row.dims)
                if turn is None:
                    turn = turns[row.dims] = rotation(row.dims, code_bits(row.dims))
                ids = np.frombuffer(row.ids, np.int64)
                length, factor, with_mean = np.frombuffer(row.scalars).reshape(3, -1)
                codes = (np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1), length, factor, with_mean)
                vectors, queries = (np.frombuffer(x).reshape(-1, row.dims) for x in (row.vectors, row.queries))
                found = list(search(ids, vectors, codes, np.frombuffer(row.query_ids, np.int64), queries, np.asarray(row.mean, np.float64), turn, k))
                if found:
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]),
                            "vec_id": np.concatenate([x for _, x, _ in found]),
                            "score": np.concatenate([s for _, _, s in found]),
                        }
                    )

    return run


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, finite throughout, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (dims, id, vector) as block rows of about ``size`` vectors of equal dimensions."""
    counts = rows.groupBy("dims").agg(F.ceil(F.count("*") / size).alias("blocks"))
    # As many rows as there are different dimensions.
    dealt = rows.join(F.broadcast(counts), "dims").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    return dealt.select("dims", "block", "id", "vector").groupBy("dims", "block").applyInPandas(_pack_group, _BLOCK)


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by inner product of each row for which ``queries`` holds, among all other ids.

    Vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do rows without an id; vectors are
    compared with those of the same number of components. Fewer than ``k`` candidates: all of them. Ties go to the smaller
    id. Repeated rows count as often as they occur. Other columns are not read.
    """
    rows = vectors.withColumn("_query", F.coalesce(queries, F.lit(False))).filter(usable(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.size(vector).alias("dims"), F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), "_query")
    place = F.posexplode("vector").alias("at", "x")
    means = rows.select("dims", place).groupBy("dims", "at").agg(F.avg("x").alias("m"))
    means = means.groupBy("dims").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    means = written(means, "means")
    stored = written(_blocks(rows, BLOCK_VECTORS).join(means, "dims").mapInPandas(_encode_blocks, _CODED), "codes")
    asked = written(_blocks(rows.filter("_query"), BLOCK_QUERIES).select("dims", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")
    # Each block of queries goes to each block of codes.
    blocks = stored.select("dims", "block")
    asked = asked.join(blocks, "dims")
    tasks = partitions(vectors.sparkSession)
    pairs = stored.repartition(tasks, "dims", "block").join(asked.repartition(tasks, "dims", "block"), ["dims", "block"]).join(F.broadcast(means), "dims")
    found = pairs.mapInPandas(_search_blocks(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
