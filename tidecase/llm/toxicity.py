"""Toxic spans by a linear-chain conditional random field over words.

Only documents carry labels. Features of a word (itself and its first 3 to 8 letters) that occur in toxic documents far beyond
chance are evidence; a word of a toxic document with such a feature is a token labelled toxic, every other token is not. The
field has two states, a weight per feature, and transitions, and is trained on these tokens by gradient ascent on the likelihood. Forward-backward
marginals of all words of a text give its offending spans, and two sums of them its score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.llm.common import crc_fold, forget, release_memory, table, text_or_empty, tidy, worker_cache, written

#: Labelled documents that features are counted on, and that the field is trained on, of which it takes so many characters at most. Of
#: either class there are a quarter at least, where there are as many.
COUNT_DOCS = 20_000
TRAIN_DOCS = 2_500
TRAIN_CHARS = 20_000
MOST_FEATURES = 4_000
#: Likelihood ratio statistic from which a feature is evidence: chance alone reaches it once in some ten million features.
EVIDENCE = 27.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words that are worked on as one row; messages go on from row to row of a text.
CHAIN = 128
#: Chains that are worked on side by side; bounds the memory, in the driver as well.
SIDE_BY_SIDE = 2_000
#: Features that a task counts before it hands counts on.
GATHERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    lower = text.lower()
    return _WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in _WORD.findall(text)]


def _words_of(texts: pa.ChunkedArray) -> list[list[str]]:
    """The words of each text, a word that comes again being the same object: the driver holds each once."""
    seen: dict[str, str] = {}
    return [[seen.setdefault(w, w) for w in _words(t.as_py())] for t in texts]


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Field:
    """Weights of features, of the bias and of transitions, and the score's three coefficients."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros(len(names))
        self.bias = -4.0
        self.steps = np.zeros(3)  # log weights of the transitions 0-1, 1-0, 1-1 against 0-0
        self.score_weights = np.array([-3.0, 0.0, 0.0])
        self.key = uuid.uuid4().hex

    def known(self, word: str) -> list[int]:
        return [i for f in features(word) if (i := self.index.get(f)) is not None]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, the probability of the toxic state at each word."""
        emission = worker_cache(f"emissions {self.key}", lambda: _Emissions(self)).__getitem__
        values = [np.fromiter(map(emission, words), np.float64, len(words)) for words in texts]
        flat = np.exp(np.clip(np.concatenate([*values, np.zeros(0)]), -30, 30))
        starts, lengths = _chains([len(v) for v in values])
        first = np.isin(starts, np.cumsum([0, *(len(v) for v in values)]))
        step = np.exp(self.steps)
        before, after = _carried(flat, starts, lengths, first, step)
        p = np.empty(len(flat))
        for a in range(0, len(starts), SIDE_BY_SIDE):
            b = a + SIDE_BY_SIDE
            at, inside = _rows(starts[a:b], lengths[a:b])
            odds, _ = _forward_backward(flat[at], inside, step, before[a:b], after[a:b])
            p[at[inside]] = (odds / (1 + odds))[inside]
        return np.split(p, np.cumsum([len(v) for v in values])[:-1]) if values else []

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-self.score_weights @ _summary(p))))


class _Emissions(dict):
    """Log odds of the toxic state by the word alone; a bounded number is remembered."""

    def __init__(self, field: Field):
        super().__init__()
        self._field = field

    def __missing__(self, word: str) -> float:
        e = float(self._field.bias + sum(self._field.weights[i] for i in self._field.known(word)))
        if len(self) < 200_000:
            self[word] = e
        return e


def _summary(p: np.ndarray) -> np.ndarray:
    """What the score sees of a text's marginals: their sum, damped, and their maximum."""
    return np.array([1.0, np.log1p(p.sum()), p.max(initial=0.0)])


def _chains(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains that texts of so many words are cut into, one text after the other."""
    starts, sizes, base = [], [], 0
    for n in lengths:
        cut = np.arange(0, n, CHAIN)
        starts.append(base + cut)
        sizes.append(np.minimum(n - cut, CHAIN))
        base += n
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *sizes])


def _rows(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of chains, one chain a row, and which of them are in the chain."""
    at = starts[:, None] + np.minimum(np.arange(lengths.max(initial=0)), lengths[:, None] - 1)
    return at, np.arange(at.shape[1]) < lengths[:, None]


def _carried(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chain, the odds of the forward message from the word before it (nan at the start of a text) and of the backward one to its last word.

    What a chain does to messages is a matrix of two by two, the product over its words; texts of one chain need none.
    """
    before, after = np.full(len(starts), np.nan), np.ones(len(starts))
    later = np.flatnonzero(~first)
    if not len(later):
        return before, after
    up, down, stay = step
    products = np.empty((len(later), 2, 2))
    for a in range(0, len(later), SIDE_BY_SIDE):
        b = a + SIDE_BY_SIDE
        at, inside = _rows(starts[later[a:b]], lengths[later[a:b]])
        product = np.broadcast_to(np.eye(2), (len(at), 2, 2))
        for t in range(at.shape[1]):
            odds = e[at[:, t]][:, None]
            top, low = product[:, 0], product[:, 1]
            new = np.stack([top + down * low, odds * (up * top + stay * low)], axis=1)
            product = np.where(inside[:, t, None, None], new / new.sum((1, 2), keepdims=True), product)
        products[a:b] = product
    heads = later[first[later - 1]] - 1  # the first chains of texts that have more
    at, inside = _rows(starts[heads], lengths[heads])
    ends, _ = _forward_backward(e[at], inside, step)
    forward = dict(zip(heads.tolist(), ends[np.arange(len(heads)), lengths[heads] - 1].tolist()))
    for k, chain in enumerate(later.tolist()):
        r = forward[chain - 1]
        before[chain] = r
        (a, b), (c, d) = products[k].tolist()
        forward[chain] = (c + d * r) / (a + b * r)
    for k in range(len(later) - 1, -1, -1):
        chain, b = later[k], after[later[k]]
        m = products[k]
        after[chain - 1] = (m[0, 1] + m[1, 1] * b) / (m[0, 0] + m[1, 0] * b)
    return before, after


def _forward_backward(
    e: np.ndarray, inside: np.ndarray, step: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior odds of state 1 at each place of each chain (rows), and the expected numbers of transitions 0-1, 1-0, 1-1 within it.

    ``e``: odds by the word; ``step``: weights of those transitions, that of 0-0 being 1; ``before``, ``after``: odds of the messages that come
    in, as from ``_carried``. Works with the odds of forward and backward messages, which is all that two states need.
    """
    up, down, stay = step
    rows, n = e.shape
    forward, backward = np.empty((rows, n)), np.ones((rows, n))
    end = np.ones(rows) if after is None else after
    if n:
        into = 1.0 if before is None else np.where(np.isnan(before), 1.0, (up + stay * before) / (1 + down * before))
        forward[:, 0] = e[:, 0] * into
        backward[:, n - 1] = end
    for t in range(1, n):
        r = forward[:, t - 1]
        forward[:, t] = e[:, t] * (up + stay * r) / (1 + down * r)
    expected = np.zeros(3)
    for t in range(n - 2, -1, -1):
        ahead = np.where(inside[:, t + 1], e[:, t + 1] * backward[:, t + 1], 0)
        last = ~inside[:, t + 1]
        backward[:, t] = np.where(last, end, (down + stay * ahead) / (1 + up * ahead))
        r = forward[:, t]
        total = 1 + up * ahead + down * r + stay * r * ahead
        for k, part in enumerate((up * ahead, down * r, stay * r * ahead)):
            expected[k] += (part / total)[~last].sum()
    return forward * backward, expected


def train(field: Field, texts: list[list[str]], toxic: list[int], rounds: int = 40, weights: list[float] | None = None) -> Field:
    """Fit the field on weakly labelled words by full gradients with adaptive steps, then the score on its marginals.

    ``weights``: of the texts in the score's fit, where the classes were drawn at other rates than they occur.
    """
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words in texts for w in words), np.int64, sum(map(len, texts)))
    pairs = [(row, i) for w, row in vocabulary.items() for i in field.known(w)]
    row, column = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    evident = np.bincount(row, minlength=len(vocabulary)) > 0
    owner = np.repeat(toxic, [len(w) for w in texts]) if texts else np.zeros(0)
    labels = evident[ids] & (owner > 0)
    starts, lengths = _chains([len(w) for w in texts])
    # Chains without evidence are alike but for their lengths: the bias and the transitions learn from a fixed share of them.
    hits = np.add.reduceat(evident[ids].astype(int), starts) if len(starts) else np.zeros(0)
    keep = (hits > 0) | (np.arange(len(starts)) % 8 == 0)
    weight = np.where(hits > 0, 1.0, 8.0)[keep]
    starts, lengths = starts[keep], lengths[keep]
    at = starts[:, None] + np.minimum(np.arange(lengths.max(initial=0)), lengths[:, None] - 1)
    inside = np.arange(at.shape[1]) < lengths[:, None]
    y = np.where(inside, labels[at], False) if len(ids) else np.zeros(at.shape, bool)
    word = ids[at] if len(ids) else np.zeros(at.shape, np.int64)
    both = inside[:, 1:] & inside[:, :-1]
    seen = np.array([(~y[:, :-1] & y[:, 1:] & both).sum(), (y[:, :-1] & ~y[:, 1:] & both).sum(), (y[:, :-1] & y[:, 1:] & both).sum()], float)
    parameters = np.concatenate([field.weights, [field.bias], field.steps])
    k, size = len(field.weights), max(1.0, float(labels.sum()))
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, rounds + 1):
        scores = np.full(len(vocabulary), parameters[k]) + np.bincount(row, parameters[column], len(vocabulary))
        odds, expected = _forward_backward(np.exp(np.clip(scores[word], -30, 30)), inside, np.exp(parameters[k + 1 :]))
        miss = np.where(inside, y - odds / (1 + odds), 0) * weight[:, None]
        by_word = np.bincount(word.ravel(), miss.ravel(), len(vocabulary))
        gradient = np.concatenate([np.bincount(column, by_word[row], k), [by_word.sum()], seen - expected]) / size
        gradient -= 1e-4 * parameters
        mean = 0.8 * mean + 0.2 * gradient
        square = 0.95 * square + 0.05 * gradient * gradient
        parameters = parameters + 0.4 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
    field.weights, field.bias, field.steps = parameters[:k], float(parameters[k]), parameters[k + 1 :]
    x = np.array([_summary(p) for p in field.marginals(texts)]).reshape(-1, 3)
    target, by = np.array(toxic, float), np.ones(len(toxic)) if weights is None else np.array(weights)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (by * (target - p)) - 0.1 * w
        curve = (x * (by * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    field.score_weights = w
    return field


def _constant(toxic: bool) -> Field:
    """A field without evidence, whose score is one class."""
    field = Field([])
    field.score_weights = np.array([8.0 if toxic else -8.0, 0.0, 0.0])
    return field


def _quota(most: int, toxic: int, n: int) -> tuple[int, int]:
    """How many of ``most`` documents to take of the clean and of the toxic ones."""
    of_toxic = min(max(round(most * toxic / n), most // 4), most - most // 4)
    return most - of_toxic, of_toxic


def _drawn(labels: DataFrame, most: int, toxic: int, n: int) -> DataFrame:
    """At most ``most`` labelled ids, those of least hash of either class."""
    clean, hot = _quota(most, toxic, n)
    of = [labels.filter(F.col("toxic") == kind).orderBy("h", "doc_id").limit(size) for kind, size in ((0, clean), (1, hot))]
    return of[0].union(of[1])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of (text, toxic): how many toxic texts, and how many in all, have a feature, as far as the task has come."""

    def counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "a", "n"])

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for feature in {f for word in set(_words(text.as_py())) for f in features(word)}:
                c = counts.setdefault(feature, [0, 0])
                c[0] += toxic
                c[1] += 1
            if len(counts) > GATHERED:
                yield counted(counts)
                counts = {}
    yield counted(counts)


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Field learned from ``labels(doc_id, toxic)``, from which the caller leaves out what must not be seen.

    Labels of ids that no document has teach nothing. The samples are labelled documents of least hashed ids, ``COUNT_DOCS`` and ``TRAIN_DOCS`` of them at most; only
    they meet the texts, so the label rows sent to all tasks are bounded as well. Without documents of both classes
    to train on, the score is that of the class there is (clean without any).
    """
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = labels.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64(F.lit(6), "doc_id"))
    known = written(known, "labels")
    sizes = known.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    hot, n = int(sizes["toxic"] or 0), int(sizes["n"])
    if not hot or hot == n:
        return _constant(hot > 0)
    sample = texts.join(F.broadcast(_drawn(known, COUNT_DOCS, hot, n)), "doc_id")
    found = sample.select("text", "toxic").mapInArrow(tidy(_count_features), "feature string, a long, n long")
    counts = found.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).filter("a >= 3")
    clean, hot_drawn = (min(size, have) for size, have in zip(_quota(COUNT_DOCS, hot, n), (n - hot, hot)))
    base, a, m = hot_drawn / (clean + hot_drawn), F.col("a"), F.col("n")
    ratio = 2 * (a * F.log(a / m / base) + F.when(m > a, (m - a) * F.log((m - a) / m / (1 - base))).otherwise(0.0))
    # a feature's share of toxic documents as it would be among all labelled ones
    share = a * (hot / hot_drawn) / (a * (hot / hot_drawn) + (m - a) * ((n - hot) / clean))
    best = counts.withColumn("g", ratio).filter((F.col("g") >= EVIDENCE) & (share >= 0.6) & (a / m > base)).orderBy(F.desc("g"), "feature").limit(MOST_FEATURES)
    field = Field([r["feature"] for r in best.select("feature").collect()])
    own = texts.withColumn("text", F.substring("text", 1, TRAIN_CHARS)).join(F.broadcast(_drawn(known, TRAIN_DOCS, hot, n)), "doc_id")
    rows = own.orderBy("h", "doc_id", "text").limit(2 * TRAIN_DOCS).select("text", "toxic").toArrow()
    toxic = rows["toxic"].to_pylist()
    if len(set(toxic)) < 2:
        return _constant(bool(sum(toxic)))
    weight = {1: hot / n / np.mean(toxic), 0: (1 - hot / n) / (1 - np.mean(toxic))}
    field = train(field, _words_of(rows["text"]), toxic, weights=[weight[t] for t in toxic])
    del rows
    forget()
    release_memory()
    return field


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Offsets, in code points, of runs of words that are toxic likelier than not."""
    out: list[dict[str, int]] = []
    before = False
    for match, value in zip(_WORD.finditer(text), p):
        if value >= 0.5:
            if before:
                out[-1]["end"] = match.end()
            else:
                out.append({"start": match.start(), "end": match.end()})
        before = value >= 0.5
    return out


def _tag(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).to_pylist()
                marginals = field.marginals([_words(t) for t in texts])
                scores = [field.score(p) for p in marginals]
                spans = [_spans(t, p) if p.max(initial=0.0) >= 0.5 else [] for t, p in zip(texts, marginals)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                columns = [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of each row, from its whole text alone.

    A null text counts as empty; a text without words has the score of no evidence. Repeated rows are scored one by one. Without a
    toxic label, or without a clean one, to learn from, all texts get the score of the labels there are (clean if there are none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 5) == 0).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(tidy(_tag(shared)), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` whose whole texts score below 0.5, all columns as they are; rows with a null text stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                marginals = shared.value.marginals([_words(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([shared.value.score(p) < 0.5 for p in marginals], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def seen_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(crc_fold("doc_id", 5) != 0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold, then tag all documents."""
    return tag(docs, fit(docs, seen_labels(labels)))


def conditional_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
