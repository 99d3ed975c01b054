import hashlib

import pytest
from pyspark.sql import functions as F

from tidecase.llm import sketch


def edited(rows):
    """(doc_id, n_chars, sha256 of the edited text), as the definition has it."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, [-ord(c) for c in (r[1] or "")]), reverse=True)
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        t, after = text or "", order[(i + 1) % len(order)][1] or ""
        out.append((doc_id, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1000, 3, 1])
def test_edited_texts_over_blocks(make, prose, monkeypatch, block):
    monkeypatch.setattr(sketch, "BLOCK_DOCS", block)
    rows = [(i * 7 % 1009 - 200, prose(i % 23, i)) for i in range(60)] + [(-10**12, "far é away"), (10**15, None), (5000, "")]
    assert got(sketch.fingerprints(make(rows))) == edited(rows)


@pytest.mark.parametrize("coarse", [1, 3, 7])
def test_borders_in_two_levels(make, prose, monkeypatch, coarse):
    monkeypatch.setattr(sketch, "BLOCK_DOCS", 2)
    monkeypatch.setattr(sketch, "COARSE", coarse)
    rows = [(i * 7 % 1009 - 200, prose(i % 23, i)) for i in range(60)] + [(-10**12, "far é away"), (10**15, None), (5000, ""), (5000, "b"), (None, "x")]
    assert got(sketch.fingerprints(make(rows))) == edited(rows)
    assert "Python" not in sketch.fingerprints(make(rows))._jdf.queryExecution().toString()


def test_edges(edges, empty, edge_rows, make):
    rows = sketch.fingerprints(edges).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["n_chars"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and 0 <= r["kept_in_edited"] <= 1
    assert len(rows) == len(edge_rows) and by_text[0] == {""}
    assert sketch.fingerprints(empty).collect() == []
    (alone,) = sketch.fingerprints(make([(1, "ab cd")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and alone["near_next"] == 1.0


def sketched(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return sketch.with_sketch(df, F.col("text"), "sketch", **more)


def test_small_sketches_are_exact_and_merge(spark, prose):
    a, b = prose(60, 1), prose(30, 2)
    both = sketched(spark, [a, b, ""]).alias("x").crossJoin(sketched(spark, [a, b, ""]).alias("y"))
    x, y = F.col("x.sketch"), F.col("y.sketch")
    out = {(r[0], r[1]): r[2:] for r in both.select("x.i", "y.i", sketch.resemblance(x, y), sketch.containment(x, y), sketch.distinct_shingles(x)).collect()}
    assert out[0, 0] == (1.0, 1.0, 56.0) and out[0, 1] == (0.0, 0.0, 56.0) and out[2, 2] == (1.0, 1.0, 0.0) and out[2, 0] == (0.0, 1.0, 0.0)


def test_parts_merge_to_the_whole(spark, prose):
    texts = [prose(400, s) for s in range(6)]
    df = sketched(spark, texts).withColumn("g", F.col("i") % 2)
    merged = {r["g"]: r["sketch"] for r in sketch.merged_by(df, ["g"]).collect()}
    for g in (0, 1):
        hashes = sorted({h for r in sketched(spark, texts, k=10**6).collect() if r["i"] % 2 == g for h in r["sketch"]})
        assert merged[g] == hashes[: sketch.K]


def test_estimates_are_close(spark, prose):
    base = prose(3000, 9).split()
    half = " ".join(base[:1500] + prose(1500, 10).split())
    rows = sketched(spark, [" ".join(base), half]).collect()
    df = spark.createDataFrame([(rows[0]["sketch"], rows[1]["sketch"])], "x array<long>, y array<long>")
    r, c, n = df.select(sketch.resemblance(F.col("x"), F.col("y")), sketch.containment(F.col("x"), F.col("y")), sketch.distinct_shingles(F.col("x"))).first()
    assert abs(r - 1 / 3) < 0.15 and abs(c - 0.5) < 0.2 and abs(n - 2996) < 900


def test_no_python_in_the_plan(edges):
    plan = sketch.fingerprints(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
