"""Language identification: known words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is cut into character n-grams (its ends marked); the
longest length of which any n-gram is known decides, with the mean log frequency of the known ones. Counts come from a
bounded, hashed sample of labelled documents of each language; the model keeps the most frequent words and n-grams of each language, however
small, and their counts in all languages. Every language that is learned from can be predicted, and every whole text is scored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecase.llm.common import crc_fold, release_memory, table, text_or_empty, tidy, worker_cache, written

#: Labelled documents to learn from, for each language.
TRAIN_DOCS = 5_000
#: Words and character n-grams that the languages share among them, and what each has at least.
MODEL_WORDS = 120_000
MODEL_GRAMS = 60_000
LEAST_TOKENS = 1_000
#: Tokens by languages up to which frequencies are in a table; beyond it only those that there are.
TABLE_CELLS = 4_000_000
LONGEST_GRAM = 4
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = r"[^\p{L}]+"


class Model:
    """Log frequencies of words and n-grams in each language.

    ``words`` and ``grams``: counts by token, one per language. Kept as what a token has beyond one that a language lacks, for the languages that have it.
    """

    def __init__(self, languages: list[str], words: dict[str, list[int]], grams: dict[str, list[int]]):
        sparse = [[(token, i, n) for token, counts in table_.items() for i, n in enumerate(counts) if n] for table_ in (words, grams)]
        self._build(languages, *sparse, len(words), len(grams))

    @classmethod
    def of_counts(cls, languages: list[str], words: list[tuple[str, int, int]], grams: list[tuple[str, int, int]]) -> Model:
        """From (token, number of the language, count), the entries of a token side by side."""
        model = cls.__new__(cls)
        model._build(languages, words, grams, len({w for w, _, _ in words}), len({g for g, _, _ in grams}))
        return model

    def _build(self, languages, words, grams, n_words: int, n_grams: int) -> None:
        self.languages, self.key = languages, uuid.uuid4().hex
        self.rows: dict[str, int] = {}
        size, column, extra, lacking, starts = len(languages), [], [], [], [0]
        # Words as they are; n-grams behind a mark that no word holds, so that both fit one table.
        for mark, entries, tokens in (("", words, n_words), ("\x00", grams, n_grams)):
            of = np.array([i for _, i, _ in entries], np.int64)
            n = np.array([n for _, _, n in entries], np.float64)
            whole = np.bincount(of, n, size) + 0.5 * tokens + 1
            lacking.append(np.log(0.5 / whole) if size else np.zeros(0))
            column.append(of)
            extra.append(np.log((n + 0.5) / 0.5))
            for token, same in groupby(entries, key=itemgetter(0)):
                self.rows[mark + token] = len(starts) - 1
                starts.append(starts[-1] + sum(1 for _ in same))
        self._column, self._extra, self._starts = np.concatenate(column), np.concatenate(extra), np.array(starts)
        self._lacking = lacking
        self._table = None
        if len(self.rows) * size <= TABLE_CELLS:  # few languages: looked up faster in a table
            self._table = np.zeros((len(self.rows), size))
            of = np.repeat(np.arange(len(self.rows)), np.diff(self._starts))
            self._table[of, self._column] = self._extra

    def sum_of(self, rows: list[int], kind: int) -> np.ndarray:
        """Sum of the log frequencies of known tokens, words (``kind`` 0) or n-grams (1)."""
        if self._table is not None:
            return len(rows) * self._lacking[kind] + self._table[rows].sum(0)
        r = np.array(rows, np.int64)
        a, n = self._starts[r], self._starts[r + 1] - self._starts[r]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return len(rows) * self._lacking[kind] + np.bincount(self._column[at], self._extra[at], len(self.languages))

    def _backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in range(LONGEST_GRAM, 0, -1):
            source = marked if n > 1 else word
            known = [r for i in range(len(source) - n + 1) if (r := self.rows.get("\x00" + source[i : i + n])) is not None]
            if known:
                return self.sum_of(known, 1) / len(known)
        return np.zeros(len(self.languages))

    def score(self, text: str) -> tuple[str, float]:
        """The likeliest language (the first in order among equals) and its posterior under even odds."""
        words = _WORD.findall(text.lower())
        if not words or not self.languages or not any(w[0].isalpha() or any(c.isalpha() for c in w) for w in words):
            return UNDETERMINED, 0.0
        found = [self.rows.get(w, -1) for w in words]
        total = self.sum_of([r for r in found if r >= 0], 0)
        unseen = worker_cache(f"unseen words {self.key}", dict)
        for w, r in zip(words, found):
            if r < 0:
                extra = unseen.get(w)
                if extra is None:
                    extra = self._backoff(w)
                    if len(unseen) < 100_000:
                        unseen[w] = extra
                total = total + extra
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, learn: Column) -> Model:
    """Model of the rows of ``docs`` (``doc_id, text, lang``) for which ``learn`` holds and ``lang`` is not null."""
    rows = docs.filter(learn & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not sizes:
        return Model([], {}, {})
    languages = sorted(r["lang"] for r in sizes)
    # About TRAIN_DOCS of each language, by a hash of the id.
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, TRAIN_DOCS / r["n"]))))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = sample.select("lang", F.explode(F.split(F.lower("text"), _SPLIT)).alias("token")).filter("token <> ''").groupBy("lang", "token").agg(F.count("*").alias("n"))
    words = written(words, "words")
    marked = F.concat(F.lit("^"), "token", F.lit("$"))
    def cuts(n: int) -> Column:
        source = marked if n > 1 else F.col("token")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(source) - (n - 1), F.lit(1))), lambda i: F.substring(source, i, F.lit(n)))

    grams = words.select("lang", "n", F.explode(F.concat(*(cuts(n) for n in range(1, LONGEST_GRAM + 1)))).alias("token"))
    grams = grams.groupBy("lang", "token").agg(F.sum("n").alias("n"))

    number = {name: i for i, name in enumerate(languages)}

    def most(counts: DataFrame, keep: int) -> list[tuple[str, int, int]]:
        share = max(keep // len(languages), LEAST_TOKENS)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
        kept = counts.withColumn("place", place).filter(F.col("place") <= share).select("token").distinct()
        repeated = counts.groupBy("token").agg(F.sum("n").alias("all")).filter("all > 1").select("token")
        entries = counts.join(kept, "token").join(repeated, "token").select("token", "lang", "n").toArrow()
        return sorted(zip(entries["token"].to_pylist(), map(number.__getitem__, entries["lang"].to_pylist()), entries["n"].to_pylist()))

    model = Model.of_counts(languages, most(words, MODEL_WORDS), most(grams, MODEL_GRAMS))
    release_memory()
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            own = batch.columns[:-1]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row; only the text is an input.

    A null text, or one without a letter, is ``und`` with score 0; so is every text under a model of no labelled rows. Words that the model
    knows nothing of leave all languages even, and the first in order is named. Repeated rows are scored one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 4) == 2).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(tidy(_score(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of ``least`` or more, all columns as they are.

    A model of no labelled rows can decide nothing, so all rows stay.
    """
    if not model.languages:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py() or "") for t in batch.column(at)]
            yield batch.filter(pa.array([name != UNDETERMINED and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents outside the held-out fold, then predict all."""
    return predict(docs, fit(docs.select("doc_id", "text", "lang"), crc_fold("doc_id", 4) != 2))


def word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
