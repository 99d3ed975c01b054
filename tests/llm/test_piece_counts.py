import random

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from tidecase.llm import piece_counts

PARTS = ["a", "the", "Th", " ", "  ", "\n", "▁", ".", ",", "'s", "é", "漢", "字", "𝔘", "\x00", "\t", "　", "\xa0", "0", "12", "_", "²", "<s>", "</s>", "<unk>", "(", "\r", "ß", "да", "<0x0A>", "x" * 70, "漢字" * 40]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def test_pretokens_add_up(library):
    counter, rng = piece_counts.PieceCounter(), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert sum(counter.count(counter.cut(text))) == len(library.encode(text)), repr(text)


def direct(library, rows):
    out = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows]
    return sorted([(*r, r[2] > 4096) for r in out], key=str)


@pytest.mark.parametrize("frequent", [piece_counts.FREQUENT, 30, 1])
def test_documents(make, prose, library, frequent):
    rows = [(i, prose(40 + i, i % 9)) for i in range(60)] + [(900, "lorem 漢字 " * 9000), (901, "y" * 30_000), (902, ("z" * 90 + " ") * 50), (903, ("z" * 90 + " ") * 3)]
    out = piece_counts.token_counts(make(rows), frequent=frequent).collect()
    assert sorted(map(tuple, out), key=str) == direct(library, rows)


def test_edges(edges, empty, edge_rows, library):
    assert sorted(map(tuple, piece_counts.token_counts(edges, frequent=2).collect()), key=str) == direct(library, edge_rows)
    assert piece_counts.token_counts(empty).collect() == []


def test_each_pretoken_is_counted_once(make):
    rows = {r["key"]: (r["n"], r["tokens"]) for r in piece_counts.pretoken_counts(make([(1, "to be or not to be"), (2, "be\n\n" + "q" * 100)])).collect()}
    assert rows[" be"] == (3, 1) and rows["\n"] == (2, 1) and len(rows) == 6 and [k for k in rows if k.startswith("\n") and len(k) == 33]
