"""Bottom-k sketches of word-shingle hashes, in DataFrame functions throughout.

A sketch is the sorted array of the ``K`` smallest distinct 48-bit hashes of a text's shingles. Sketches of parts merge into the
sketch of the whole; two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecase.llm.common import partitions, table, text_or_empty, written

K = 128
WORDS = 5
HASH_BITS = 48
#: Documents in a block of neighbours. Borders are in two levels: at most so many of the first, and for each stretch between them so many of the second.
BLOCK_DOCS = 1_000
COARSE, FINE = 1_000, 1_000
_SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: Column, name: str, words: int = WORDS, k: int = K) -> DataFrame:
    """``df`` with the sketch of a text: shingles of ``words`` lower-cased words, all as one where there are fewer, none without words."""
    cut = df.withColumn("_words", F.filter(F.split(F.lower(text), _SPACE), lambda w: w != ""))
    w = F.col("_words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
    hashes = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 64 - HASH_BITS))
    return cut.withColumn(name, F.when(F.size(w) > 0, bottom(hashes, k)).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: its ``k`` least hashes, first within each task, so a large group is not gathered."""
    flat = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return flat.withColumn("r", rank).filter(F.col("r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two texts; 1 for two empty sketches, exact while both hold all their shingles."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def _block_of(doc_id: Column, borders: Column, most: int) -> Column:
    """How many of at most ``most`` sorted borders are below ``doc_id``, by halving: block ``i`` ends with border ``i``, the last one is open."""
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(borders, mid) < doc_id)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def _dealt_to_blocks(rows: DataFrame) -> DataFrame:
    """Rows with the ``_block`` of neighbouring ids they go to, ``_key`` to order by, and whether they are a ``_guest`` there.

    The top row of each block (its border, an id of the table) is also a guest of the block of larger ids: it follows that
    block's smallest id. The largest id of all is a guest of the block of the smallest ids. Up to ``COARSE`` blocks need the first level of borders only; beyond
    that each stretch between two of them is cut at quantiles of its own, which go to all tasks as a table of ``COARSE`` rows at most.
    """
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    size = rows.agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("blocks"), F.max("_key").alias("top")).first()
    wanted = max(1, int(size["blocks"] or 0))
    coarse, key = min(wanted, COARSE), F.col("_key")
    fine = min(-(-wanted // coarse), FINE)

    def quantiles(parts: int) -> Column:
        return F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10 * parts)

    found = rows.agg(quantiles(coarse).alias("b")).first()["b"] if coarse > 1 else []
    borders = sorted({*(found or [])} - {size["top"]})
    values = F.array(*(F.lit(b) for b in borders)) if borders else F.array().cast("array<bigint>")
    rows = rows.withColumn("_coarse", _block_of(key, values, len(borders)))
    within = F.array().cast("array<bigint>")
    if fine > 1:
        end = F.coalesce(F.get(values, F.col("_coarse")), F.lit(size["top"]))
        cuts = rows.groupBy("_coarse").agg(quantiles(fine).alias("_cuts"))
        cuts = written(cuts.select("_coarse", F.array_sort(F.array_distinct(F.filter("_cuts", lambda c: c < end))).alias("_cuts")), "borders")
        rows, within = rows.join(F.broadcast(cuts), "_coarse"), F.col("_cuts")
    rows = rows.withColumn("_fine", _block_of(key, within, fine))
    block = F.col("_coarse").cast("long") * FINE + F.col("_fine")
    after = F.when(F.get(within, F.col("_fine")) == key, block + 1).when(F.get(values, F.col("_coarse")) == key, (F.col("_coarse").cast("long") + 1) * FINE)
    place = lambda at, guest: F.struct(at.alias("block"), F.lit(guest).alias("guest"))
    own, top = place(block, False), key == F.lit(size["top"])
    places = F.when(top, F.array(own, place(F.lit(0).cast("long"), True))).when(after.isNotNull(), F.array(own, place(after, True))).otherwise(F.array(own))
    dealt = rows.withColumn("_at", F.explode(places))
    return dealt.select("doc_id", "text", "_key", F.col("_at.block").alias("_block"), F.col("_at.guest").alias("_guest"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and estimated counts for each row.

    The edited text: the last half (rounded down) of a text's code points replaced by as many, or all, of the first of the next
    document in descending ``doc_id`` (after the last: the first; a single document follows itself). A null text counts as empty; the likeness of two empty
    fingerprints is 1, of an empty one and another 0. Rows that repeat an id follow each other in the order of their texts,
    null ids come last. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = Window.partitionBy("_block").orderBy("_guest", F.col("_key").desc(), "text")
    placed = _dealt_to_blocks(rows).repartition(partitions(docs.sparkSession), "_block")
    placed = with_sketch(placed, F.col("text"), "sketch")
    follow = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("_guest"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    both = with_sketch(follow.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), F.col("edited"), "edited_sketch")
    both = both.select("doc_id", "n_chars", "sketch", F.coalesce("next_sketch", "sketch").alias("next_sketch"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited_sketch")
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )


def bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
