import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidecase.llm import quality


def test_bad_texts_are_told_apart(spark, make, prose):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.8
        text = prose(40, i) if good else " ".join(w + rng.choice(["$$$", "###"]) for w in prose(40, i).split())
        rows.append((i, text, "en", f"src{i % 7}"))
        labels.append((i, int(good)))
    seen = [x for x in labels if x[0] % 3]
    out = {r["doc_id"]: r for r in quality.judge(make(rows), spark.createDataFrame(seen, "doc_id long, quality int")).collect()}
    assert all(out[i]["keep"] == g for i, g in labels)


def test_sites_shrink_toward_their_priors(spark, make):
    # The texts say nothing; hosts differ, and one path of the good host has one bad label only.
    rows = [(i, "same text", "en", "good" if i < 50 else "bad") for i in range(100)] + [(100, "same text", "fr", "good"), (101, "same text", "fr", "new")]
    labels = [(i, int(i < 50)) for i in range(100) if i not in (3, 60)]
    out = {r["doc_id"]: r for r in quality.judge(make(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert out[3]["quality"] > 0.9 > 0.1 > out[60]["quality"]
    assert out[100]["path_rate"] == out[100]["host_rate"] > 0.9  # no label at the path: the host's rate
    assert abs(out[101]["path_rate"] - 0.5) < 0.05  # neither: the share of all


def test_strength_by_hand(spark):
    sites = spark.createDataFrame([(10, 9), (10, 1), (1, 1)], "n long, good long")
    s = sites.agg(quality.strength(sites, F.lit(0.5)).alias("s")).first()["s"]
    r = 2 * 10 * (0.16 - 0.025) / (2 * 10 * 0.25 * 0.9)
    assert math.isclose(s, 1 / r - 1)


def test_a_document_does_not_vote_for_itself(spark, make):
    rows = [(i, "t", "en", "h") for i in range(4)]
    out = {r["doc_id"]: r for r in quality.judge(make(rows), spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")).collect()}
    assert out[0]["path_rate"] > out[3]["path_rate"] > out[1]["path_rate"]


def test_edges(spark, edges, empty, edge_rows):
    for labels in ([], [(11, None), (None, 0), (11, 1), (11, 0), (2, 1), (999, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        rows = quality.judge(edges, table).collect()
        assert len(rows) == len(edge_rows) and all(0 < r["quality"] < 1 for r in rows)
        assert quality.judge(empty, table).collect() == []
    assert all(r["keep"] == 1 for r in quality.judge(edges, spark.createDataFrame([], "doc_id long, quality int")).collect())


def bins(text):
    """The statistics in plain code, for texts of ASCII characters."""
    size, words, lines = max(len(text), 1), re.split(r"\s+", text), text.split("\n")
    share = lambda part, whole, steps: min(math.floor(steps * part / whole), steps)
    return {
        "letters": share(sum(c.isalpha() for c in text), size, 25),
        "capitals": share(sum(c.isupper() for c in text), size, 25),
        "symbols": min(math.floor(math.log1p(1000 * len(re.findall(r"[^A-Za-z0-9\s.,;:'\"?()\-]", text)) / size) * 2), 14),
        "digits": min(math.floor(math.log1p(1000 * sum(c.isdigit() for c in text) / size)), 7),
        "length": min(math.floor(math.log2(1 + len(words))), 16),
        "word_length": min(math.floor(len(text) / len(words)), 15),
        "repeated_words": share(len(set(words)), len(words), 20),
        "repeated_lines": share(len(set(lines)), len(lines), 10),
    }


def posterior(rows, labels):
    """{row number: (host rate, path rate, quality)} by the definition, one document at a time; ``rows``: (doc_id, text, lang, source)."""
    label = {}
    for doc_id, good in labels:
        label[doc_id] = min(label.get(doc_id, 1), int(good > 0))
    known = [(bins(t), label[i], s, f"{s}/{g}") for i, t, g, s in rows if i in label]
    goods, bads = sum(x[1] for x in known), sum(1 - x[1] for x in known)
    ratio = {}
    for name in quality.STATISTICS:
        for b in {x[0][name] for x in known}:
            good, n = sum(x[1] for x in known if x[0][name] == b), sum(x[0][name] == b for x in known)
            ratio[name, b] = math.log((good + 0.5) / (goods + 1) / ((n - good + 0.5) / (bads + 1)))

    def site(place):
        out = {}
        for x in known:
            n, good = out.get(x[place], (0, 0))
            out[x[place]] = (n + 1, good + x[1])
        return out

    def strength(sites):
        surplus = sum(n * ((good / n - p) ** 2 - p * (1 - p) / n) for n, good, p in sites if n > 1)
        scale = sum(n * p * (1 - p) * (1 - 1 / n) for n, good, p in sites if n > 1)
        r = min(max(surplus / scale if scale > 0 else 0.0, quality.CORRELATION[0]), quality.CORRELATION[1])
        return 1 / r - 1

    hosts, paths = site(2), site(3)
    base = (goods + 1) / (len(known) + 2)
    weight = strength([(n, good, base) for n, good in hosts.values()])
    shrunk = lambda good, n, toward, by: (good + by * toward) / (n + by)
    host_of = {x[3]: x[2] for x in known}
    path_weight = strength([(n, good, shrunk(hosts[host_of[p]][1], hosts[host_of[p]][0], base, weight)) for p, (n, good) in paths.items()])
    out = []
    for i, t, g, s in rows:
        own, seen = label.get(i, 0), i in label
        (hn, hg), (pn, pg) = hosts.get(s, (0, 0)), paths.get(f"{s}/{g}", (0, 0))
        host_rate = shrunk(hg - own, hn - seen, base, weight)
        path_rate = shrunk(pg - own, pn - seen, host_rate, path_weight)
        odds = math.log(path_rate / (1 - path_rate)) + quality.EVIDENCE_WEIGHT * sum(ratio.get(x, 0.0) for x in bins(t).items())
        out.append((i, host_rate, path_rate, 1 / (1 + math.exp(-odds))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_like_plain_code(spark, make, prose, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        text = prose(rng.randint(1, 60), 1000 * seed + i).title() if rng.random() < 0.4 else prose(rng.randint(1, 60), i) + rng.choice(["!! ## 12", ".\nend.\nend.", " (so) 7"])
        rows.append((i, text, rng.choice(["en", "fr"]), "src0" if i % 3 == 0 else f"src{rng.randrange(6)}"))
    labels = [(i, int(rng.random() < (0.8 if rows[i][3] in ("src0", "src1") else 0.3))) for i in range(0, 160, 2)] + [(4, 0), (9_999, 1)]
    got = sorted(tuple(r) for r in quality.judge(make(rows), spark.createDataFrame(labels, "doc_id long, quality int")).select("doc_id", "host_rate", "path_rate", "quality").collect())
    for have, want in zip(got, sorted(posterior(rows, labels)), strict=True):
        assert have[0] == want[0] and have[1:] == pytest.approx(want[1:], rel=1e-9)
