"""From raw documents to packed training sequences: filters, near duplicates, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last return the columns of
``documents``. Stages are joined by Parquet tables in the shared folder, so a lost executor costs part of one stage.

Stages decide by row: null and repeated ids take no other row with them, and extra columns pass through. A null text counts as empty, has no toxic words,
is of no language, is in no group of copies and weighs nothing in the mix. A stage that has nothing to learn from (no
labels, no languages) keeps all rows. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecase.llm import jaccard, language, mixture, packing, toxicity
from tidecase.llm.common import crc_fold, table, written

#: Share of the tokens left that the mix keeps; no document is taken twice.
MIX_PERCENT = 85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose marginals of toxic words add up to a score of 0.5 or more go."""
    labels = toxicity.seen_labels(table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language is likelier than all others together, go; all stay if no language is known."""
    return language.keep_identified(docs, language.fit(docs.select("doc_id", "text", "lang"), crc_fold("doc_id", 4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sharing 0.8 of their five-word shingles, the row of the smallest id stays."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the prefixes of their sources, by the target weights, stay, the last of each prefix as a whole."""
    return mixture.keep_mixed(docs, MIX_PERCENT, mixture.WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and token ids are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
