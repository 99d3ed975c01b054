"""Token-id output: documents as one stream of ids in document order, stored as independent compressed blocks.

Format: Parquet rows ``(part, block_no, n_ids, n_docs, block)``. ``part`` counts the ranges of ascending ids; the stream of a part is
cut into blocks of ``BLOCK_IDS`` ids at most, between documents where they fit into one. ``block`` is, little-endian, a header (magic, version, ids, documents, the block's most
frequent id, offset in the part's stream, crc32 of its ids), one entry ``(doc_id, start in the stream, length)`` for each
document that has ids in it, the range coder's output, and a crc32 of all that. A block is decoded from itself alone.
Spark's writer commits the files, so a lost executor or a second attempt leaves no half-written block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from tidecase.llm import context_coder
from tidecase.llm.common import partitions, shared_path, table, text_or_empty, tidy, written
from tidecase.llm.tokens import shared_encoder

BLOCK_IDS = 2048
VOCABULARY = 50_257
END_ID = 2
#: Blocks coded side by side; bounds a task's memory.
LANES = 4096
_MAGIC, _VERSION = b"TCTB", 2
_HEADER = struct.Struct("<4sHHIIIqI")
_ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("length", "<i8"), ("no_id", "<i8")])
_BLOCKS = "part int, block_no long, n_ids int, n_docs int, block binary"


class BlockError(ValueError):
    """A block that does not hold what its checksums say."""


def pack_block(ids: np.ndarray, coded: bytes, common: int, offset: int, docs: np.ndarray) -> bytes:
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    body = _HEADER.pack(_MAGIC, _VERSION, 0, len(ids), len(docs), common, offset, crc) + docs.tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_blocks(blocks: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, ids, document entries) of each block, after checking it."""
    heads, coded, entries = [], [], []
    for b in blocks:
        if len(b) < _HEADER.size + 4 or zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise BlockError("block checksum differs")
        head = _HEADER.unpack_from(b)
        if head[:2] != (_MAGIC, _VERSION):
            raise BlockError("not a block of this format")
        end = _HEADER.size + head[4] * _ENTRY.itemsize
        heads.append(head)
        entries.append(np.frombuffer(b[_HEADER.size : end], _ENTRY))
        coded.append(b[end:-4])
    out = []
    for head, docs, ids in zip(heads, entries, context_coder.decode(coded, [h[3] for h in heads], [h[5] for h in heads], VOCABULARY)):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[7]:
            raise BlockError("id checksum differs")
        out.append((head[6], ids, docs))
    return out


def _coded_rows(part: int, first_no: int, blocks: list[tuple[int, bytes, list[tuple]]]) -> pa.RecordBatch:
    """Rows of consecutive blocks, each given as (offset in the stream, ids, document entries)."""
    ids = [np.frombuffer(raw, "<u4").astype(np.int32) for _, raw, _ in blocks]
    common = [context_coder.most_common(own) for own in ids]
    coded = context_coder.encode(ids, common, VOCABULARY)
    rows = [
        (part, first_no + k, len(own), len(docs), pack_block(own, code, most, offset, np.array(docs, _ENTRY)))
        for k, ((offset, _, docs), own, code, most) in enumerate(zip(blocks, ids, coded, common))
    ]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "block_no", "n_ids", "n_docs", "block"])


def _blocks_of(batches: Iterator[pa.RecordBatch], encode_column, tail: bytes) -> Iterator[tuple[int, bytes, list[tuple]]]:
    """The stream cut into blocks: a document that fits into a block is not cut."""
    size = 4 * BLOCK_IDS
    open_ids, open_docs, offset, total = bytearray(), [], 0, 0  # total: bytes of ids so far
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode_column(batch.column(1))):
            ids += tail
            entry = (doc_id or 0, total // 4, len(ids) // 4, doc_id is None)
            if open_ids and len(open_ids) + len(ids) > size:
                yield offset, bytes(open_ids), open_docs
                open_ids, open_docs, offset = bytearray(), [], total // 4
            total += len(ids)
            while len(ids) > size:
                yield offset, ids[:size], [entry]
                ids, offset = ids[size:], offset + BLOCK_IDS
            open_ids += ids
            open_docs.append(entry)
    if open_ids:
        yield offset, bytes(open_ids), open_docs


def _write_part(end_id: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, done = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), 0
        blocks = _blocks_of(batches, shared_encoder(tokenizer).encode_column, tail)
        while some := list(islice(blocks, LANES)):
            yield _coded_rows(part, done, some)
            done += len(some)

    return run


def write_token_file(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, tokenizer: str | None = None) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending ``doc_id`` order (null ids first).

    A null text counts as empty. Rows with the same id stay apart, in no fixed order among themselves. Only the id and the
    text are read, whatever other columns there are.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(tidy(_write_part(end_id, tokenizer)), _BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(path)


_FRAGMENTS = "part int, doc_id long, start long, n_tokens long, at long, n long, crc long"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and document in it: the crc32 of the document's ids there."""

    def rows(parts: list[int], blocks: list[bytes]) -> pa.RecordBatch:
        out = []
        for part, (offset, ids, docs) in zip(parts, unpack_blocks(blocks)):
            raw = ids.astype("<u4").tobytes()
            for doc_id, start, length, no_id in docs.tolist():
                a, b = max(start, offset), min(start + length, offset + len(ids))
                out.append((part, None if no_id else doc_id, start, length, a - start, b - a, zlib.crc32(raw[4 * (a - offset) : 4 * (b - offset)])))
        columns = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["part", "doc_id", "start", "n_tokens", "at", "n", "crc"])

    parts: list[int] = []
    blocks: list[bytes] = []
    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts.append(part)
            blocks.append(block.as_py())
            if len(blocks) == LANES:
                yield rows(parts, blocks)
                parts, blocks = [], []
    if blocks:
        yield rows(parts, blocks)


_POLYNOMIAL = 0xEDB88320  # of crc32, lowest power first


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo crc32's; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(4 * BLOCK_IDS)
def _shift(n_bytes: int) -> int:
    """The power of x that so many bytes of zeros multiply by; fragments have few lengths."""
    power, shift, n = 1 << 23, 1 << 31, n_bytes  # x**8; 1
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return shift


def crc_after(crc: int, more: int, n_bytes: int) -> int:
    """crc32 of X + Y from the crc32 of X, that of Y, and Y's length: X's shifted by Y's zeros, plus Y's."""
    return _times(crc, _shift(n_bytes)) ^ more


@F.pandas_udf(LongType())
def _crc_of_parts(parts: pd.Series) -> pd.Series:
    def one(rows) -> int:
        crc = 0
        for row in sorted(rows, key=lambda r: r["at"]):
            crc = crc_after(crc, int(row["crc"]), 4 * int(row["n"])) if row["at"] else int(row["crc"])
        return crc

    return parts.map(one)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded blocks.

    ``start``: ids of all documents before it. A document over several blocks gets its crc32 from those of its fragments, so
    its ids never meet in one task.
    """
    blocks = read_blocks(spark, path)
    # One row per part, as many as there were write tasks.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    fragments = written(blocks.select("part", "block").mapInArrow(tidy(_fragments), _FRAGMENTS), "fragments")
    whole = fragments.filter("n = n_tokens").select("part", "start", "doc_id", "n_tokens", "crc")
    cut = fragments.filter("n < n_tokens").groupBy("part", "start", "doc_id", "n_tokens").agg(F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
    docs = whole.union(cut.select("part", "start", "doc_id", "n_tokens", _crc_of_parts("parts")))
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token_file")
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path)
