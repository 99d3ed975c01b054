"""N-gram Jaccard join with adaptive multi-match prefixes.

Each document is the set of its word shingles, ordered from rare to frequent by corpus counts. Two sets of resemblance ``t`` or more
share at least ``l`` of the first ``n - ceil(t n) + l`` shingles of either, for any ``l``. Each document takes the ``l`` at which postings to read
plus candidates to verify are estimated to cost least: a longer prefix, but more shared shingles asked for. A pair is a
candidate when it shares the smaller ``l`` of its two and its positions still allow the resemblance; candidates are verified exactly.

Equal sets are one class and take part once. A very large group of near copies would give all its pairs; so classes with a shingle
of thousands are first verified against a few hubs, and shingles whose classes are in one component by then are done with.
Of what is left, shingles that few classes have give pairs, and classes with a shingle of many are compared in blocks without their pairs
being listed. No pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecase.llm.common import in_parts, table, text_or_empty, tidy, tidy_driver, worker_cache, written
from tidecase.llm.components import components

#: Shingles are counted in so many buckets; the table of counts that goes to every task has this size whatever the corpus. A shingle
#: is known as frequent once it stands out from the load of its bucket, so a larger corpus wants more buckets.
COUNT_BUCKETS = 1 << 22
COUNT_SLICES = 64
MOST_MATCHES = 4
#: Cost of verifying a candidate against that of reading a posting.
VERIFY_COST = 1.0
HUBS = 2
#: Classes that share a shingle with more than so many others are compared with hubs first, for at most so many rounds and while a
#: round spares a fifth of their postings. All that is left is joined in any case.
HUB_FROM = 4096
MOST_ROUNDS = 4
#: Shingles that more classes than this have are handled in blocks of so many classes.
HEAVY = 48
BLOCK = 256
#: Bits of the filter for documents whose sets are needed again, and of one of Spark's bitmaps.
FILTER_BITS, FILTER_PART = 1 << 24, 1 << 15
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """64-bit hashes of words; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def shingle_hashes(text: str, words: int, known: dict) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order.

    Words: runs of anything but ASCII white space, A-Z lower-cased. Fewer words than a shingle has: all of them as one.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z and ASCII white space count
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + len(mixed)]) * _MIX[i % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingle_set(text: str, words: int, known: dict) -> np.ndarray:
    """The distinct ones, sorted."""
    return np.unique(shingle_hashes(text, words, known))


def _known() -> _Hashes:
    """One table per Python worker."""
    return worker_cache("word hashes", _Hashes)


def _count(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(COUNT_BUCKETS, np.uint32), _known()
        for batch in batches:
            for text in batch.column(1):
                np.add.at(counts, shingle_hashes(text.as_py(), words, known) & np.uint64(COUNT_BUCKETS - 1), 1)
        # Mostly small numbers in two bytes each, which the shuffle's compression shrinks.
        parts = np.minimum(counts, 65_535).astype("<u2").reshape(COUNT_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "counts"])

    return run


def _sum_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNT_BUCKETS // COUNT_SLICES, np.uint64)
    for batch in batches:
        for counts in batch.column(1):
            total += np.frombuffer(counts.as_buffer(), "<u2")
    total = np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.binary())], names=["slice", "counts"])


def shingle_counts(rows: DataFrame, words: int) -> np.ndarray:
    """How often shingles of each bucket occur in all documents, above the usual load of a bucket.

    Each task counts all its texts and hands on one row per slice of the buckets; the sums, of fixed size, come to the driver.
    """
    tables = rows.mapInArrow(tidy(_count(words)), "slice int, counts binary")
    counts = np.zeros((COUNT_SLICES, COUNT_BUCKETS // COUNT_SLICES), np.uint32)
    sums = tables.groupBy("slice").applyInArrow(_sum_counts, "slice int, counts binary").toArrow()
    for part, own in zip(sums["slice"].to_pylist(), sums["counts"]):
        counts[part] = np.frombuffer(own.as_buffer(), "<u4")
    counts = counts.ravel()
    usual = np.uint32(np.median(counts))
    np.maximum(counts, usual, out=counts)
    counts -= usual
    np.minimum(counts, (1 << 20) - 1, out=counts)
    return counts.view(np.int32)


def _ceil(numerator: int, denominator: int) -> int:
    return -(-numerator // denominator)


def prefix(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The chosen prefix, rare shingles first, and how many shared shingles it asks for.

    A shingle is named by a number that orders by frequency: its bucket's count in 20 bits, then 43 bits of its hash.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), 1
    seen = counts[(hashes & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)].astype(np.int64)
    names = np.sort((seen << 43) | (hashes >> np.uint64(21)).astype(np.int64))
    least = _ceil(percent * n, 100)
    short = n - least + 1
    most = min(MOST_MATCHES, least)  # a longer prefix cannot ask for more than the pair must share
    postings = np.cumsum(names[: short + most - 1] >> 43)[short - 1 :].astype(float) + np.arange(short, short + most)
    wanted = np.arange(1, most + 1)
    choice = int(np.argmin(postings + VERIFY_COST * postings / wanted**2))
    return names[: short + choice], choice + 1


def _describe(words: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = counts.value
        known = _known()
        for batch in in_parts(batches):
            ids, texts, digests = batch.columns
            sets = [shingle_set(t.as_py(), words, known) for t in texts]
            chosen = [prefix(s, table_, percent) for s in sets]
            offsets = np.cumsum([0, *(len(p) for p, _ in chosen)])
            names = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*(p for p, _ in chosen), np.zeros(0, np.int64)])))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            own = [ids, digests, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), names, pa.array([m for _, m in chosen], pa.int32())]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "digest", "n", "key", "prefix", "matches"])

    return run


def _needed_sets(words: int, needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(needed.value, np.uint8), bitorder="little")
        known = _known()
        for batch in in_parts(batches):
            keep = bits[batch.column(2).to_numpy(zero_copy_only=False)].astype(bool)
            sets = [shingle_set(t.as_py(), words, known) for t in batch.column(1).filter(pa.array(keep))]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])

    return run


def _filter_bit(column: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(-1))), F.lit(FILTER_BITS))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``left`` with each of ``right``: products of 0-1 matrices, some shingles at a time."""
    sets = [*left, *right]
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    twice = np.bincount(column, minlength=len(names)) > 1
    place = np.cumsum(twice) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = twice[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(twice.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        some = np.zeros((len(sets), 4096), np.float32)
        some[row[a:b], column[a:b] - first] = 1
        counts += some[: len(left)] @ some[len(left) :].T
    return counts


def _block_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        own, lo, hi = rows["own"].to_numpy(), rows["lo"].iloc[0], rows["hi"].iloc[0]
        i, j = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        counts = _shared_counts([sets[k] for k in i], [sets[k] for k in j]) if len(i) and len(j) else np.zeros((0, 0))
        size, node, root = np.array([len(s) for s in sets]), rows["node"].to_numpy(), rows["component"].to_numpy().copy()
        links = 100 * counts.astype(np.int64) >= percent * (size[i][:, None] + size[j][None, :] - counts.astype(np.int64)) if counts.size else counts
        # Of the links, those that join what is not joined yet.
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        out = []
        for x, y in np.argwhere(links):
            a, b = find(int(root[i[x]])), find(int(root[j[y]]))
            if a != b:
                parent[a] = b
                out.append((int(node[i[x]]), int(node[j[y]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


class _Join:
    """One join: the described documents, their classes, and the sets read again for candidates."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        digested = self.rows.withColumn("digest", text_digest())
        counts = self.spark.sparkContext.broadcast(shingle_counts(self.rows, words))
        self.described = written(digested.mapInArrow(tidy(_describe(words, percent, counts)), "doc_id long, digest binary, n long, key binary, prefix array<long>, matches int"), "described")
        counts.destroy()
        del counts
        tidy_driver(self.spark)
        classes = self.described.filter("n > 0").groupBy("key").agg(
            F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("matches").alias("matches")
        )
        self.classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.facts = self.classes.select("node", "n", "matches", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"))
        self.postings = self._shared_postings()
        tidy_driver(self.spark)

    def _shared_postings(self) -> DataFrame:
        """``node, name, n, matches``: prefix shingles that several classes have.

        A linked pair shares at least the smaller ``matches`` of its two in both prefixes. A class that shares fewer than the least of its own
        and of all classes it shares a shingle with has no link and is dropped, which leaves more shingles alone; this is done twice.
        """
        rest = self.classes.select("node", "matches", F.explode("prefix").alias("name"))
        for turn in range(2):
            rest = rest.select("node", "name", "matches")
            # counted before the shuffle; the join's partitions can be split, so a name that many classes have is no task's alone
            common = rest.groupBy("name").agg(F.count("*").alias("size"), F.min("matches").alias("asked")).filter("size > 1").select("name", "asked")
            rest = written(rest.join(common, "name"), f"postings{turn}")
            able = rest.groupBy("node").agg(F.count("*").alias("c"), F.min("asked").alias("asked")).filter("c >= asked").select("node")
            rest = rest.join(able, "node")
        sizes = self.facts.select("node", F.col("n").cast("int").alias("n"))
        return written(rest.join(sizes, "node").select("node", "name", "n", "matches"), "postings")

    def _near(self, a: str, b: str):
        """Whether sizes allow a link. What a pair can share is left to ``possible``: a prefix shingle may be in the other set beyond its prefix."""
        t, n_a, n_b = self.percent, F.col(f"n_{a}"), F.col(f"n_{b}")
        return (100 * n_a >= t * n_b) & (100 * n_b >= t * n_a)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """``node, hashes`` of the given classes, computed again from the texts, of documents that a filter of fixed size lets through."""
        wanted = written(self.classes.join(nodes.select("node").distinct(), "node").select("key", "node", "least"), "wanted")
        bits = bytearray(FILTER_BITS // 8)
        of = wanted.select(_filter_bit("least").alias("bit")).groupBy(F.floor(F.col("bit") / FILTER_PART).alias("part"))
        for row in of.agg(F.bitmap_construct_agg(F.col("bit") % FILTER_PART).alias("bits")).collect():  # FILTER_BITS in all
            at = row["part"] * FILTER_PART // 8
            bits[at : at + FILTER_PART // 8] = row["bits"]
        needed = self.spark.sparkContext.broadcast(bytes(bits))
        sets = self.rows.withColumn("bit", _filter_bit("doc_id")).mapInArrow(tidy(_needed_sets(self.words, needed)), "key binary, hashes binary")
        found = written(wanted.join(sets.dropDuplicates(["key"]), "key").select("node", "hashes"), "sets")
        needed.destroy()
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that link."""
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(_verify(self.percent)), "a long, b long")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b, shared)`` whose sizes, shared prefix shingles and positions allow a link."""
        for side in "ab":
            pairs = pairs.join(self.facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "matches", "p", "last"))), side)
        t = self.percent
        sizes = (100 * F.col("n_a") >= t * F.col("n_b")) & (100 * F.col("n_b") >= t * F.col("n_a"))
        # Beyond the prefix that ends earlier in the common order, each of that set's shingles could still be shared.
        bound = F.col("shared") + F.when(F.col("last_a") < F.col("last_b"), F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
        enough = (F.col("shared") >= F.least("matches_a", "matches_b")) & ((100 + t) * bound >= t * (F.col("n_a") + F.col("n_b")))
        return pairs.filter(sizes & enough)

    def placed(self, found: DataFrame | None) -> DataFrame:
        """The postings with their components; a class that is linked with none yet is its own."""
        if found is None:
            return self.postings.withColumn("component", F.col("node"))
        own = self.postings.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = own.groupBy("name").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("name")
        return written(own.join(mixed, "name").select("node", "name", "n", "matches", "component"), "mixed_postings")

    def hub_links(self, own: DataFrame, turn: int) -> DataFrame:
        """Links of each class with those hubs of other components that it shares most shingles with.

        For each shingle, the class that shares the largest part of its prefix with others is a hub (in a group of edited copies, one near the
        original), and classes of least salted hash. A pair's shared shingles are counted where one is a hub: some links are missed here, none is made up.
        """
        own = self._with_share(own)
        least = [F.min(F.struct(F.xxhash64(F.lit(HUBS * turn + salt), "node").alias("h"), F.col("node").alias("hub")))["hub"] for salt in range(1, HUBS)]
        hubs = own.groupBy("name").agg(F.array_distinct(F.array(F.max(F.struct("w", "node"))["node"], *least)).alias("hubs")).select("name", F.explode("hubs").alias("hub"))
        places = own.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")).distinct()
        shared = own.join(hubs, "name").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"), F.first("component").alias("component"))
        shared = shared.join(places, "hub").filter("component <> hub_component").select(F.col("node").alias("a"), F.col("hub").alias("b"), "shared")
        best = self.possible(shared).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), asc=False), 1, 2 * HUBS).alias("best"))
        pairs = best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return self.verified(written(pairs, "hub_pairs"))

    def _with_share(self, own: DataFrame) -> DataFrame:
        """Postings with ``w``: the part of its class's prefix that other classes share."""
        widely = own.groupBy("node").agg(F.count("*").alias("c")).join(self.facts, "node").select("node", (F.col("c") / F.col("p")).alias("w"))
        return own.join(widely, "node")

    def cross_links(self, own: DataFrame) -> DataFrame:
        """All links between classes of different components, or as many as join the same components."""
        own = written(self._with_share(own), "shares")
        names = written(own.groupBy("name").agg(F.count("*").alias("size"), F.max(F.struct("w", "node"))["node"].alias("hub")).withColumn("is_heavy", F.col("size") > HEAVY), "names")
        own = own.join(names.select("name", "hub", "is_heavy"), "name")
        heavy = written(own.filter("is_heavy").select("hub", "node", "component"), "heavy")
        counts = heavy.groupBy("node").agg(F.count("*").cast("int").alias("heavy"))
        light = own.filter("not is_heavy").join(counts, "node", "left").fillna(0, ["heavy"])
        return self.verified(written(self._light_pairs(light), "cross_pairs")).union(self._heavy_links(heavy.distinct()))

    def _light_pairs(self, own: DataFrame) -> DataFrame:
        """Possible pairs by shingles that few classes have.

        Shared shingles that many have are not counted, so a class may share all its ``heavy`` ones besides. Most pairs share too
        few and end before anything else is looked up.
        """
        columns = ("name", "node", "component", "n", "matches", "heavy")
        a, b = (own.select(*(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
        near = (F.col("component_a") < F.col("component_b")) & self._near("a", "b")
        shared = a.join(b, (F.col("name_a") == F.col("name_b")) & near)
        besides, asked = F.least("heavy_a", "heavy_b"), F.least("matches_a", "matches_b")
        shared = shared.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("light"), F.first(besides).alias("besides"), F.first(asked).alias("asked"))
        shared = shared.withColumn("shared", F.col("light") + F.col("besides")).filter("shared >= asked")
        return self.possible(shared.select("a", "b", "shared")).select("a", "b")

    def _heavy_links(self, groups: DataFrame) -> DataFrame:
        """Links among classes that share a shingle of many, by blocks: each two blocks of a hub's group meet in one task.

        Classes with a shared shingle are in the group of its hub, so no pair is missed; a block yields links enough to join the same components.
        """
        groups = written(groups, "groups")
        blocks = groups.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = groups.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = dealt.select("hub", "node", "component", "own", other)
        dealt = dealt.select("hub", "node", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        rows = dealt.join(self.sets_of(groups), "node")
        return rows.groupBy("hub", "lo", "hi").applyInPandas(_block_links(self.percent), "a long, b long")

    def found(self) -> DataFrame:
        """``node, component`` of every class that has a link."""
        links = found = None
        own = self.placed(None)
        before = float("inf")
        for turn in range(MOST_ROUNDS):
            crowded = written(own.groupBy("name").agg(F.count("*").alias("size")).filter(F.col("size") > HUB_FROM), "crowded")
            postings = crowded.agg(F.sum("size")).first()[0] or 0
            if not postings or postings > 0.8 * before:
                break
            before = postings
            more = self.hub_links(own.join(crowded.select("name"), "name"), turn)
            links = written(more if links is None else links.union(more), f"links{turn}")
            found = components(links)
            own = self.placed(found)
            tidy_driver(self.spark)
        last = self.cross_links(own)
        return components(last if links is None else links.union(last))


def text_digest() -> Column:
    """What tells texts apart in a row's key; a null text counts as empty."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, digest, n_shingles, component_id, component`` of each row; ``component`` is null for an empty set."""
    join = _Join(docs, words, percent)
    labelled = join.classes.join(join.found(), "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(labelled.join(least, "component").select("key", "component_id", "component"), "labels")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = join.described.select("doc_id", "digest", "n", "key").join(ids, "key", "left")
    return rows.select("doc_id", "digest", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.when(F.col("n") > 0, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked, directly or through others, share a component.

    Two documents link when the sets of their word shingles share at least ``percent`` of a hundred of their union. ``component_id`` is the
    smallest ``doc_id`` of the component. A null or blank text has an empty set and is alone: it keeps its own id. Rows that
    repeat an id are separate documents. A null ``doc_id`` is larger than any other. Other columns are not read.
    """
    return _labelled(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns as they are.

    The document of the smallest id stays, of several with that id the one of the least digest of its text; rows without an id come last. Rows that
    repeat an id and its text are one document; so are rows without an id and with the same text. An id that is repeated with
    another text is another document, and goes or stays by itself. Rows of null and blank texts are in no group and all stay.
    """
    name = "_".join(["digest", *docs.columns])  # longer than any column's name
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    near = written(_labelled(docs, words, percent).groupBy("doc_id", "digest").agg(F.min("component").alias("component"), F.count("*").alias("rows")), "groups")
    first = near.filter("component is not null").groupBy("component").agg(F.min(place).alias("first"))
    rest = near.join(first, "component").filter(place != F.col("first")).select(F.col("doc_id").alias(f"{name}_id"), F.col("digest").alias(f"{name}_of"))
    here, digest = F.col("doc_id").cast("long"), F.col(name)
    kept = docs.withColumn(name, text_digest()).join(rest, here.eqNullSafe(F.col(f"{name}_id")) & (digest == F.col(f"{name}_of")), "left_anti")
    several = near.filter("rows > 1 and component is not null").select(F.col("doc_id").alias(f"{name}_id"), F.col("digest").alias(f"{name}_of"))
    if several.isEmpty():
        return kept.select(docs.columns)
    again = here.eqNullSafe(F.col(f"{name}_id")) & (digest == F.col(f"{name}_of"))
    single = kept.join(several, again, "left_anti").select(docs.columns)
    return single.union(kept.join(several, again, "left_semi").dropDuplicates(["doc_id", name]).select(docs.columns))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)
