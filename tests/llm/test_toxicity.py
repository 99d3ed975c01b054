import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidecase.llm import toxicity
from tidecase.llm.common import _CACHE, forget


def corpus(prose, count=400):
    """Texts of which every fourth has words of a small lexicon; in some its endings vary."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(count):
        words, bad = prose(30 + i % 50, i).split(), i % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile", "hateful", "grumosk" + rng.choice(["ta", "ri", "mo"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents_and_spans(spark, make, prose):
    rows, labels = corpus(prose)
    out = {r["doc_id"]: r for r in toxicity.score_documents(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in held) for i in out)
    assert all(out[i]["predicted"] == dict(labels)[i] == int(out[i]["score"] >= 0.5) for i in held)
    for i, text in rows:
        words = {w for s in out[i]["spans"] for w in text[s["start"] : s["end"]].split()}
        assert all(w in ("Vile", "hateful") or w.startswith("grumosk") for w in words) and bool(words) == bool(dict(labels)[i])


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    e, step = np.exp(rng.normal(size=(3, 5))), np.exp(rng.normal(size=3))
    lengths = [5, 3, 1]
    inside = np.arange(5) < np.array(lengths)[:, None]
    odds, expected = toxicity._forward_backward(e, inside, step)
    weight = {(0, 0): 1.0, (0, 1): step[0], (1, 0): step[1], (1, 1): step[2]}
    sums = np.zeros(3)
    for row, n in enumerate(lengths):
        total, on, pairs = 0.0, np.zeros(n), np.zeros(3)
        for bits in np.ndindex(*[2] * n):
            p = np.prod([e[row, t] for t in range(n) if bits[t]]) * np.prod([weight[x] for x in zip(bits, bits[1:])])
            total += p
            on += p * np.array(bits)
            pairs += p * np.array([sum(x == y for x in zip(bits, bits[1:])) for y in ((0, 1), (1, 0), (1, 1))])
        assert np.allclose(odds[row, :n] / (1 + odds[row, :n]), on / total)
        sums += pairs / total
    assert np.allclose(expected, sums)


def test_messages_go_on_over_the_rows_of_a_long_text():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    field = toxicity.Field(words)
    field.weights, field.steps, field.bias = rng.normal(size=40) * 2, np.array([-1.0, 1.5, 3.0]), -0.5
    texts = [[words[k] for k in rng.integers(0, 40, n)] for n in (1, 127, 128, 129, 256, 700, 0, 5000)]
    for text, p in zip(texts, field.marginals(texts)):
        e = np.exp(np.array([[field.bias + field.weights[int(w[1:])] for w in text]]).reshape(1, -1))
        odds, _ = toxicity._forward_backward(e, np.ones(e.shape, bool), np.exp(field.steps))
        assert np.allclose(p, (odds / (1 + odds))[0], rtol=1e-9, atol=1e-12)


def test_rare_labels_and_long_texts_are_trained_on(spark, make, prose, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 60)
    rows = [(i, ("vile grumosk " if i % 50 == 0 else "") + prose(30, i)) for i in range(1500)] + [(5000, "vile grumosk " + prose(9000, 1))]
    labels = [(i, int(i % 50 == 0)) for i in range(1500)] + [(9000 + i, 0) for i in range(300)] + [(5000, 1)]
    model = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r["predicted"] for r in toxicity.tag(make(rows), model).collect()}
    assert {i for i, p in out.items() if p} == {i for i in range(0, 1500, 50)} | {5000}


def test_labels_of_absent_documents_drop_nothing(spark, make, prose):
    docs = make([(i, prose(20, i)) for i in range(6)])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, toxicity.fit(docs, labels)).count() == 6


def test_a_document_counts_once_for_a_feature(monkeypatch):
    rows = [("Vile vile villain 12 ab", 1), ("vile", 0), ("", 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], names=["text", "toxic"])
    for gathered in (100, 0):
        monkeypatch.setattr(toxicity, "GATHERED", gathered)
        sums = {}
        for out in toxicity._count_features(iter([batch])):
            for r in out.to_pylist():
                a, n = sums.get(r["feature"], (0, 0))
                sums[r["feature"]] = (a + r["a"], n + r["n"])
        assert sums == {f: (1, 1 + (f in toxicity.features("vile"))) for w in ("vile", "villain", "ab") for f in toxicity.features(w)}


def test_long_texts_are_cut_into_chains_and_seen_whole():
    field = toxicity.Field(["vile"])
    field.weights[:] = 8.0
    p = field.marginals([["mild"] * 1000 + ["vile"], [], ["vile"]])
    assert [len(x) for x in p] == [1001, 0, 1] and p[0][1000] > 0.9 and p[2][0] > 0.9 and p[0][:1000].max() < 0.1


@pytest.mark.parametrize("labels", [[], [(11, 0), (2, 0)], [(11, 1), (2, 1)], [(11, None), (None, 1), (11, 1), (11, 0), (2, 0)]])
def test_edges(spark, edges, empty, edge_rows, labels):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score_documents(edges, table).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score_documents(empty, table).collect() == []


def test_clean_rows_are_kept_as_they_are(edges, make):
    field = toxicity.Field(["vile"])
    field.weights[:], field.score_weights = 8.0, np.array([-4.0, 0.0, 8.0])
    kept = toxicity.keep_clean(make([(1, "a vile text"), (2, "a mild text"), (3, None), (None, "VILE")]), field)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a mild text"), (3, None)]
    assert toxicity.keep_clean(edges, field).count() == edges.count()


def test_offsets_are_of_code_points_even_if_lower_case_is_longer():
    text = "İİ 漢 vile, vile end"
    p = np.array([0.1, 0.1, 0.9, 0.8, 0.2])
    assert [text[s["start"] : s["end"]] for s in toxicity._spans(text, p)] == ["vile, vile"]
    assert len(toxicity._words(text)) == 5


def test_the_driver_trains_in_little_memory():
    (a, b), _ = toxicity._words_of(pa.chunked_array([["same same", "other"]]))
    assert a is b
    texts = [["word"] * toxicity.CHAIN] * 12_000
    tracemalloc.start()
    marginals = toxicity.Field([]).marginals(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(marginals) == 12_000 and peak < 90 << 20
    forget()
    assert not _CACHE
