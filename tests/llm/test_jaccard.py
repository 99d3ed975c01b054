import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidecase.llm import jaccard
from tidecase.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, percent):
    """(doc_id, shingles, component) by comparing all pairs."""
    sets = [shingles(t, words) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    return sorted(((d, len(s), least(members[root(i)])) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def copies(prose, seed, count, edits):
    """Edited copies of one text: each has a few words changed."""
    rng, base = random.Random(seed), prose(60, seed).split()
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_edges_against_brute_force(edges, empty, edge_rows, words, percent):
    assert got(jaccard.near_duplicates(edges, words, percent)) == brute(edge_rows, words, percent)
    assert got(jaccard.near_duplicates(empty, words, percent)) == []


@pytest.mark.parametrize("words, percent, hubs_from, heavy", [(3, 90, 3, 4), (3, 90, 10**9, 10**9), (5, 80, 2, 10**9), (5, 80, 10**9, 2)])
def test_groups_against_brute_force(make, prose, monkeypatch, words, percent, hubs_from, heavy):
    # hubs_from: hub rounds run for shingles of more classes; heavy: shingles of more classes are compared in blocks
    monkeypatch.setattr(jaccard, "HUB_FROM", hubs_from)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = copies(prose, 1, 40, 3) + copies(prose, 2, 15, 1) + [prose(50, s) for s in range(100, 130)] + copies(prose, 3, 20, 8)
    texts += texts[:5] + ["a b c", "A  b\tC", "a b", "x"]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    want = brute(rows, words, percent)
    assert got(jaccard.near_duplicates(make(rows), words, percent)) == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def contained(words, percent):
    """Pairs of a text and the same with rare words appended or inserted or with its end cut off, near the threshold on both sides."""
    texts = []
    for length in (24, 47, 92, 160):
        n = length - words + 1
        for k in (n * (100 - percent) // percent, n * (100 - percent) // (2 * percent), n * (100 - percent) // 100, n * (100 - percent) // 100 + 2):
            for edit in ("append", "insert", "truncate"):
                base = [f"c{len(texts)}x{i}" for i in range(length)]
                more = [f"r{len(texts)}x{i}" for i in range(k)]
                other = {"append": base + more, "insert": base[: length // 2] + more + base[length // 2 :], "truncate": base[: length - k]}[edit]
                texts += [" ".join(base), " ".join(other)]
    return texts


@pytest.mark.parametrize("words, percent, hubs_from, heavy", [(3, 90, 4096, 48), (5, 80, 4096, 48), (3, 90, 1, 48), (5, 80, 10**9, 1)])
def test_contained_texts_against_brute_force(make, monkeypatch, words, percent, hubs_from, heavy):
    monkeypatch.setattr(jaccard, "HUB_FROM", hubs_from)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rows = list(enumerate(contained(words, percent)))
    want = brute(rows, words, percent)
    assert got(jaccard.near_duplicates(make(rows), words, percent)) == want
    assert len(rows) // 5 < len({c for _, _, c in want}) < len(rows)


def test_ninety_shingles_and_five_more(make):
    base = [f"w{i}" for i in range(92)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"new{i}" for i in range(5)]))]
    assert got(jaccard.near_duplicates(make(rows), 3, 90)) == [(1, 90, 1), (2, 95, 1)]


@pytest.mark.parametrize("words, percent, shingles_of", [(3, 90, 9), (5, 80, 4)])
def test_prefixes_that_ask_for_different_numbers(make, monkeypatch, words, percent, shingles_of):
    zeros = np.zeros(jaccard.COUNT_BUCKETS, np.int32)  # as in large corpora, where rare shingles do not stand out of their buckets
    monkeypatch.setattr(jaccard, "shingle_counts", lambda rows, words: zeros)
    texts = [" ".join(f"d{k}x{i}" for i in range(shingles_of + words - 1 + more)) for k in range(20) for more in (0, 1)]
    sets = [jaccard.shingle_set(t, words, jaccard._Hashes()) for t in texts[:2]]
    assert len({jaccard.prefix(s, zeros, percent)[1] for s in sets}) == 2
    rows = list(enumerate(texts))
    assert got(jaccard.near_duplicates(make(rows), words, percent)) == brute(rows, words, percent)


def test_prefixes_never_miss_a_pair(prose):
    counts = np.zeros(jaccard.COUNT_BUCKETS, np.int64)
    for percent in (80, 90):
        texts = copies(prose, 7, 25, 4) + [prose(3, 1), prose(4, 2)]
        sets = [jaccard.shingle_set(t, 3, jaccard._Hashes()) for t in texts]
        for s in sets:
            counts[(s & np.uint64(jaccard.COUNT_BUCKETS - 1)).astype(int)] += 1
        chosen = [jaccard.prefix(s, counts, percent) for s in sets]
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    shared = len(np.intersect1d(chosen[i][0], chosen[j][0]))
                    assert shared >= min(chosen[i][1], chosen[j][1])


def test_counts_of_shared_shingles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(9)]
    counts = jaccard._shared_counts(sets[:4], sets[4:])
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_one_of_each_keeps_the_smallest_id_and_all_columns(make, prose):
    texts = copies(prose, 4, 6, 1)
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(1, "alone here"), (1, "alone here"), (2, None), (3, ""), (None, "q r"), (None, "q r"), (4, "z")]
    docs = make(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted([(1, "alone here"), (2, None), (3, ""), (4, "z"), (10, texts[0])], key=lambda x: (x[0], x[1] or ""))
    assert sum(r["doc_id"] is None for r in kept.collect()) == 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
