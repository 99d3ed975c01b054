"""Document quality by hierarchical empirical Bayes over hosts and paths.

Each document has evidence of its own: binned statistics of its text, whose log likelihood ratios between good and bad labelled
documents are counted over all of them. Labels of a site say something about the site's other documents too: the share of good ones at a path
is shrunk toward that of its host, and the host's toward the share of all, the less it is known the more. How strongly is
estimated from how much hosts, and paths within hosts, differ beyond chance. A document's log odds are those of its path plus its own
evidence; a labelled document does not count in the share that it is judged by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.llm.common import crc_fold, table, text_or_empty, written

FOLDS, HELD_OUT = 5, 0
#: Evidence is weighed down: the statistics of a text are not independent.
EVIDENCE_WEIGHT = 0.6
#: Highest correlation of labels within a site, and the lowest, that the estimate may give.
CORRELATION = (0.0005, 0.9)
_SYMBOL = r"[^\p{L}\p{N}\s.,;:'\"?()\-]"


def text_statistics(text: Column) -> dict[str, Column]:
    """Bins of a text's statistics, each a small whole number."""
    size = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, r"\s+")
    lines = F.split(text, "\n")
    count = F.size(words)
    share = lambda part, whole, steps: F.least(F.floor(steps * part / whole), F.lit(steps)).cast("int")
    scaled = lambda x, most: F.least(F.floor(x), F.lit(most)).cast("int")
    return {
        "letters": share(F.regexp_count(text, F.lit(r"\p{L}")), size, 25),
        "capitals": share(F.regexp_count(text, F.lit(r"\p{Lu}")), size, 25),
        "symbols": scaled(F.log1p(1000 * F.regexp_count(text, F.lit(_SYMBOL)) / size) * 2, 14),
        "digits": scaled(F.log1p(1000 * F.regexp_count(text, F.lit(r"\p{N}")) / size), 7),
        "length": scaled(F.log2(F.lit(1.0) + count), 16),
        "word_length": scaled(F.length(text) / count, 15),
        "repeated_words": share(F.size(F.array_distinct(words)), count, 20),
        "repeated_lines": share(F.size(F.array_distinct(lines)), F.size(lines), 10),
    }


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, host, path`` and the bins. Host: the source; path: its part in one language; null names read ``none``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("source").alias("host"), F.concat_ws("/", name("source"), name("lang")).alias("path"), text_or_empty().alias("text"))
    return rows.select("doc_id", "host", "path", *(c.alias(n) for n, c in text_statistics(F.col("text")).items()))


STATISTICS = ("letters", "capitals", "symbols", "digits", "length", "word_length", "repeated_words", "repeated_lines")


def evidence_table(labelled: DataFrame) -> dict[tuple[str, int], float]:
    """Log likelihood ratio of each bin of each statistic, smoothed; a few hundred at most, whatever the corpus."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("bin")) for s in STATISTICS)))
    counts = labelled.select("good", pairs.alias("x")).groupBy("x.statistic", "x.bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    goods = sum(r["good"] for r in counts) / len(STATISTICS)
    bads = sum(r["n"] for r in counts) / len(STATISTICS) - goods
    return {(r["statistic"], r["bin"]): math.log((r["good"] + 0.5) / (goods + 1) / ((r["n"] - r["good"] + 0.5) / (bads + 1))) for r in counts}


def evidence(ratios: dict[tuple[str, int], float]) -> Column:
    """A document's own log likelihood ratio; bins without labelled documents say nothing."""
    total: Column = F.lit(0.0)
    for s in STATISTICS:
        known = [F.lit(x) for (name, b), r in sorted(ratios.items()) if name == s for x in (b, r)]
        if known:
            total = total + F.coalesce(F.create_map(*known)[F.col(s)], F.lit(0.0))
    return EVIDENCE_WEIGHT * total


def strength(sites: DataFrame, prior: Column) -> Column:
    """Labels that the prior is worth, from ``sites(n, good)`` and what each is expected to be (``prior``).

    The squared differences from the prior are on average ``p (1 - p) (1/n + (1 - 1/n) r)``; ``r`` is the correlation within a site.
    """
    chance = prior * (1 - prior)
    gap = F.pow(F.col("good") / F.col("n") - prior, 2)
    surplus = F.sum(F.when(F.col("n") > 1, F.col("n") * (gap - chance / F.col("n"))))
    scale = F.sum(F.when(F.col("n") > 1, F.col("n") * chance * (1 - 1 / F.col("n"))))
    r = F.least(F.greatest(F.coalesce(surplus / F.when(scale > 0, scale), F.lit(0.0)), F.lit(CORRELATION[0])), F.lit(CORRELATION[1]))
    return 1 / r - 1


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, quality, keep`` of each row.

    ``quality``: posterior probability that the document is good; ``keep``: 1 if it is 0.5 or more. Labels that are null, or of null ids, say
    nothing; of repeated labels the worst counts. Empty texts have statistics like others. Without labels all is
    even and everything is kept. Repeated rows are judged one by one.
    """
    rows = written(describe(docs), "statistics")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    labelled = written(rows.join(known, "doc_id"), "labelled")
    own = evidence(evidence_table(labelled))
    # One row per path and host with labels, however many documents each has.
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    weight = float(hosts.agg(strength(hosts, F.lit(base)).alias("s")).first()["s"])
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    shrunk = lambda good, n, toward, by: (good + by * toward) / (n + by)
    paths = paths.join(hosts, "host").withColumn("prior", shrunk(F.col("host_good"), F.col("host_n"), F.lit(base), weight))
    path_weight = float(paths.agg(strength(paths, F.col("prior")).alias("s")).first()["s"])
    paths = written(paths.drop("prior"), "paths")
    # A labelled document leaves its own label out of the counts of its path and host.
    judged = rows.join(paths.select("path", "n", "good"), "path", "left").join(hosts, "host", "left").join(known.withColumnRenamed("good", "_label"), "doc_id", "left")
    less = lambda c, x: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(x, F.lit(0))
    seen = F.when(F.col("_label").isNotNull(), F.lit(1))
    judged = judged.withColumn("host_rate", shrunk(less("host_good", F.col("_label")), less("host_n", seen), F.lit(base), weight))
    judged = judged.withColumn("path_rate", shrunk(less("good", F.col("_label")), less("n", seen), F.col("host_rate"), path_weight))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence")
    judged = judged.withColumn("evidence", own).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).cast("int").alias("keep"))


def empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fold; ``held_out`` marks that fold."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
    return judge(table(spark, sf_dir, "documents"), labels).withColumn("held_out", crc_fold("doc_id", FOLDS) == HELD_OUT)
