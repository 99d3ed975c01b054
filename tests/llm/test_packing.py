import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from tidecase.llm import packing
from tidecase.llm.tokens import TextEncoder, tokenizer_path

WHOLE = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def check(rows, docs, size):
    """Every token of every document once, sequences gapless and no longer than ``size``."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text, *_ in docs:
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        want[doc_id] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in x) for d, x in by_doc.items()}
    assert got == {d: sorted(x) for d, x in want.items()}
    for x in by_sequence.values():
        x.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in x]).tolist()
        assert [r["offset"] for r in x] == [0, *ends[:-1]] and ends[-1] <= size
    return len(by_sequence)


def test_edges(spark, edges, empty, edge_rows, make):
    check(packing.packed_documents(edges, size=64).collect(), edge_rows, 64)
    special = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>" * 70), (3, "plain words")]
    check(packing.packed_documents(make(special), size=64).collect(), special, 64)
    assert packing.packed_documents(empty).collect() == []


def test_several_blocks(spark, make, prose, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 20)
    docs = [(i, prose(i % 37, i)) for i in range(90)]
    rows = packing.packed_documents(make(docs), size=100).collect()
    tokens = sum(r["length"] for r in rows)
    assert check(rows, docs, 100) <= -(-tokens // 100) + 9


def test_a_word_of_a_batch_is_looked_up_once(monkeypatch):
    class Counting(TextEncoder):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    encoder, texts = Counting(), ["the cat, the dog\nthe cat. A cat!", None, "a dog's cat"] * 300
    monkeypatch.setattr(packing, "shared_encoder", lambda file: encoder)
    monkeypatch.setattr(packing, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (pieces,) = packing._cut(8, 0, None)(iter([batch]))
    want = [[*WHOLE.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    first = [len(ids) if len(ids) <= 8 else len(ids) % 8 or 8 for ids in want]
    cuts = [(i, a, b) for i, (ids, n) in enumerate(zip(want, first)) for a, b in zip([0, *range(n, len(ids), 8)], range(n, len(ids) + 1, 8))]
    got = list(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32"))))
    assert got == [(i, a, b - a, zlib.crc32(np.array(want[i][a:b], "<u4").tobytes())) for i, a, b in cuts]
    assert encoder.asked <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(0, 5))
def test_evolved_packings_are_whole_and_no_worse_than_first_fit(lengths, seed):
    sizes = np.array(lengths, np.int64)
    best = packing.evolve(sizes, [], 30, seed)
    for bins in best:
        fill = np.bincount(bins, sizes, int(bins.max(initial=-1)) + 1)
        assert len(bins) == len(sizes) and (fill <= 30).all() and (fill > 0).all()
    free = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, f in enumerate(free) if f >= n), None)
        free.append(30 - n) if k is None else free.__setitem__(k, free[k] - n)
    assert int(best[0].max(initial=-1)) + 1 <= len(free) if lengths else not len(best[0])


def test_crossover_hands_on_whole_sequences_and_loses_nothing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 300)
    a, b = packing.evolve(lengths, [], 100, 1, generations=0, members=2)
    child = packing._child(a, b, lengths, 100, rng)
    assert len(child) == 300 and (np.bincount(child, lengths) <= 100).all()
    sets = {frozenset(np.flatnonzero(child == k)) for k in range(child.max() + 1)}
    full = {frozenset(np.flatnonzero(b == k)) for k in range(b.max() + 1) if lengths[b == k].sum() == 100}
    assert sets & full


@pytest.mark.parametrize("guests", [1, 3])
def test_migrants_join_the_population(guests):
    lengths = np.full(10, 5)
    perfect = np.arange(10) // 2
    assert packing.evolve(lengths, [perfect] * guests, 10, 0, generations=1)[0].max() == 4


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01"])
def test_crossovers_bring_the_sequences_down_to_the_least(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pieces = packing.written(packing.token_pieces(docs), "pieces")
    _, epochs = packing.packed_islands(pieces)
    islands = [r.asDict() for r in epochs[0].select("sequences", "first", "crossovers").collect()]
    least = -(-pieces.filter("length < 2048").groupBy().sum("length").first()[0] // 2048)
    assert len(islands) == packing.ISLANDS and all(r["crossovers"] > 0 and r["first"] > 1.005 * least and r["sequences"] < r["first"] for r in islands)
    assert min(r[0] for r in epochs[-1].select("sequences").collect()) == least
    rows = packing.pack(pieces).select("sequence_id").distinct().count()
    assert rows == least + pieces.filter("length = 2048").count() == 481
