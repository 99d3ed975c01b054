"""Token counts of whole texts by a SentencePiece BPE model, from the counts of their distinct pre-tokens.

Pieces of such a model never reach over certain places of a text: a word starts where marks for spaces start, and no piece holds a character
that the vocabulary has only as bytes, such as a line feed. Between two such places merging goes its own way, so a text's number of tokens is the sum over its
pre-tokens. Each distinct pre-token is counted once, by the library; documents carry frequencies of pre-tokens, never ids.

Pre-tokens that make up at least 1 in ``FREQUENT`` of all occurrences, of which there can be ``FREQUENT`` at most, are sent to all tasks and summed
where a document is read. The others, each of them rare by that bound, are joined by shuffle, so no key of the join is hot. Pre-tokens of more than
``LONG`` characters go under a 128-bit digest.

A null text counts as empty and has no tokens. Texts of white space only, marks for spaces in a text, strings of special tokens and bytes
outside the vocabulary are counted as the library does. A text of any length is cut as a whole. Repeated rows are counted one by one,
whatever their ids; null ids stay null. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidecase.llm.common import table, tidy, written

DEFAULT_FILE = "piece_bpe_32k.model"
FREQUENT = 1 << 20
LONG = 64
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 200_000
SPACE = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-῿"
#: Words with the spaces before them, the finest way of cutting first: letters apart from other characters, or not.
_CUTS = (re.compile(rf"\n| *[{_LETTERS}]+| *[^{_LETTERS} \n]+| +"), re.compile(r"\n| *[^ \n]+| +"))


class PieceCounter:
    """Cuts texts into pre-tokens and counts the pieces of a pre-token."""

    def __init__(self, file: str | None = None):
        self.library = SentencePieceProcessor(model_file=file or tokenizer_path(DEFAULT_FILE))
        lib = self.library
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or lib.encode("\n x  y ", out_type=str)[0] != SPACE:
            raise ValueError("pieces of this model reach over spaces or line feeds, or its texts are changed before they are cut")
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}  # neighbours that a piece may hold
        whole = [p.replace(SPACE, " ") for p in pieces]
        self._findall = next(c for c in _CUTS if c is _CUTS[-1] or all(len(c.findall(p)) == 1 for p in whole)).findall

    def cut(self, text: str) -> list[str]:
        """Pre-tokens, whose pieces one after the other are those of the text; the library sets a space before a text."""
        if not text:
            return []
        found = self._findall(" " + text.replace(SPACE, " "))
        if max(map(len, found)) <= LONG:
            return found
        return [part for p in found for part in (self._shorter(p) if len(p) > LONG else [p])]

    def _shorter(self, pretoken: str) -> list[str]:
        """Cuts a long one between neighbours that no piece holds, which leaves runs of spaces and of what merges."""
        marked = pretoken.replace(" ", SPACE)
        at = [0, *(i for i in range(1, len(marked)) if marked[i - 1 : i + 1] not in self.inside), len(marked)]
        return [pretoken[a:b] for a, b in zip(at, at[1:])]

    def count(self, pretokens: list[str]) -> list[int]:
        """Behind a line feed, which is two tokens there with the space before it, the library takes a pre-token as it is."""
        return [len(ids) - 2 for ids in self.library.encode(["\n" + p for p in pretokens], num_threads=1)]


@cache
def shared_counter(file: str | None = None) -> PieceCounter:
    """One per Python worker; it holds the model and nothing of the texts."""
    return PieceCounter(file)


def key_of(pretoken: str) -> str:
    return pretoken if len(pretoken) <= LONG else "\n" + blake2b(pretoken.encode(), digest_size=16).hexdigest()


def _gather(file: str | None):
    def batch_of(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key_of(p) for p in counts], pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "pretoken", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared_counter(file).cut
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(cut(text.as_py() or ""))
                if len(counts) >= GATHERED:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return run


def _count(file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(file)
        for batch in batches:
            tokens = pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], names=["key", "n", "tokens"])

    return run


def pretoken_counts(docs: DataFrame, file: str | None = None, text: str = "text") -> DataFrame:
    """``key, n, tokens`` of each distinct pre-token: its occurrences in all texts and its number of pieces."""
    found = docs.select(F.col(text).cast("string")).mapInArrow(tidy(_gather(file)), "key string, pretoken string, n long")
    distinct = found.groupBy("key").agg(F.first("pretoken").alias("pretoken"), F.sum("n").alias("n"))
    return written(distinct.mapInArrow(tidy(_count(file)), "key string, n long, tokens long"), "pretokens")


def _frequencies(file: str | None, frequent):
    """Per document: the tokens of its frequent pre-tokens, and the others with their frequencies."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = shared_counter(file).cut, frequent.value
        for batch in batches:
            sums, rest = [], []
            for text in batch.column(2):
                total, others = 0, []
                for pretoken, n in Counter(cut(text.as_py() or "")).items():
                    key = key_of(pretoken)
                    tokens = known.get(key)
                    if tokens is None:
                        others.append({"key": key, "n": n})
                    else:
                        total += n * tokens
                sums.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sums, pa.int64()), pa.array(rest, kind)], names=["uid", "doc_id", "n_bytes", "n_tokens", "rest"])

    return run


def token_counts(docs: DataFrame, file: str | None = None, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``."""
    spark = docs.sparkSession
    pretokens = pretoken_counts(docs, file)
    total = pretokens.agg(F.sum("n")).first()[0] or 0
    top = pretokens.filter(F.col("n") * frequent >= total).select("key", "tokens").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column("key").to_pylist(), top.column("tokens").to_pylist())))
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    own = written(rows.mapInArrow(tidy(_frequencies(file, shared)), "uid long, doc_id long, n_bytes long, n_tokens long, rest array<struct<key:string,n:long>>"), "pretoken-frequencies")
    rare = own.select("uid", F.explode("rest").alias("r")).select("uid", "r.key", "r.n")
    of_rare = rare.join(pretokens.select("key", "tokens"), "key").select("uid", (F.col("n") * F.col("tokens")).alias("n_tokens"))
    parts = own.drop("rest").unionByName(of_rare, allowMissingColumns=True)
    sums = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
