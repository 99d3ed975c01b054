import numpy as np
from pyspark.sql import functions as F

from tidecase.llm import quantized_search as q


def brute(vectors, k, asks):
    out = {}
    for i, v in vectors:
        if asks(i):
            scored = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in vectors if j != i and len(w) == len(v))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(q, "BLOCK_VECTORS", 300)
    monkeypatch.setattr(q, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(0)
    data = [(i, rng.standard_normal(32).astype(np.float32).tolist()) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got, want = found(q.nearest(df, F.col("vec_id") % 20 == 0, k=20)), brute(data, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.97 * 20 * len(want)
    near = dict(data)
    assert all(abs(s - float(np.dot(np.float64(near[i]), np.float64(near[j])))) < 1e-12 for i, x in got.items() for j, s in x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (4, [-1.0, 0.0], 1), (40, [2.0, 1.0], 1),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 1.0], 1),
        (20, [0.0, 0.0], 1), (60, [1.0, 2.0, 3.0], 1), (61, [1.0, 2.0, 2.0], 1), (80, [5.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dims int").withColumn("block", F.lit("?")).withColumn("id", F.lit("?"))
    got = found(q.nearest(df, F.col("vec_id") % 20 == 0, k=3))
    assert got == {0: [(40, 2.0), (1, 1.0), (2, 1.0)], 40: [(0, 2.0), (1, 2.0), (2, 2.0)], 60: [(61, 11.0)]}
    assert q.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_estimates_are_within_their_bounds_mostly():
    rng = np.random.default_rng(2)
    x, mean = rng.standard_normal((400, 64)), np.full(64, 0.1)
    turn = q.rotation(64, 256)
    assert np.allclose(turn.T @ turn, np.eye(64))
    guess, off = q.estimates(q.encode(x, mean, turn), x[:40], mean, turn)
    inside = np.abs(guess - x[:40] @ x.T) <= off
    assert inside.mean() > 0.9


def test_the_mean_itself_is_a_valid_vector():
    mean = np.array([1.0, 2.0])
    codes = q.encode(np.array([[1.0, 2.0], [3.0, 4.0]]), mean, q.rotation(2, 256))
    guess, off = q.estimates(codes, np.array([[1.0, 1.0]]), mean, q.rotation(2, 256))
    assert abs(guess[0, 0] - 3.0) < 1e-5 and off[0, 0] == 0
