import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecase.llm import context_coder, token_file, tokens
from tidecase.llm.common import shared_path
from tidecase.llm.tokens import TextEncoder, shared_encoder, tokenizer_path

WHOLE = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Zé\n\t.,'!1ß漢 \x00\x85-s")), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(shared_encoder().encode(text), "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "the cat <|endoftext|><|endoftext|> sat", "<|endoftext", "x\n<|endoftext|> y"])
def test_strings_of_added_tokens(text):
    assert np.frombuffer(shared_encoder().encode(text), "<u4").tolist() == ids_of(text)
    assert text != "a<|endoftext|>b" or ids_of(text) == [64, 50256, 65]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list("ab Zé\n\t.,'!1ß漢 \x00\x85-_s")), max_size=30), max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_columns_give_the_ids_of_the_texts(texts, group):
    column = pa.array([None, *texts], pa.string()).slice(1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "GROUP_BYTES", group)
        assert [np.frombuffer(x, "<u4").tolist() for x in shared_encoder().encode_column(column)] == [ids_of(t) for t in texts]


def test_a_piece_of_a_column_is_looked_up_once():
    class Counting(TextEncoder):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    encoder, texts = Counting(), ["the cat, the dog\nthe cat. A cat!", "a dog's cat"] * 700
    got = list(encoder.encode_column(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:2]] == [ids_of(t) for t in texts[:2]] and got[2:] == got[:2] * 699
    assert encoder.asked <= 20


def test_words_of_a_column_are_known_without_the_marks_behind_them():
    encoder, texts = TextEncoder(), ["né, né. né! (né) où? naïf×é÷é.", "ÿ! né"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_column(pa.array(texts))] == [ids_of(t) for t in texts]
    assert len(encoder._words.hashes) == 4 and not any(x[-1] in ",.!?)" and len(x) > 2 for x in encoder._with_marks if "né" in x or "où" in x)


def test_few_remembered_pieces_of_a_column_give_the_same_ids():
    small, texts = TextEncoder(remembered=3), ["the cat's hat, the dog. The end!\nIt's \"so\" on", "où est le chat?\nIci", None] * 2
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_column(pa.array(texts))] == [ids_of(t) for t in texts]
    assert len(small) <= 3 and len(small._words.hashes) <= 6


def test_few_remembered_pieces_give_the_same_ids():
    small, text = TextEncoder(remembered=3), "the cat's hat, the dog. The end!\nIt's \"so\" <|endoftext|> x"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60) | st.integers(0, 50_256), max_size=80), max_size=6))
def test_coder_round_trip(blocks):
    arrays = [np.array(b, np.int32) for b in blocks]
    common = [context_coder.most_common(a) for a in arrays]
    assert all(c == max(sorted(set(b)), key=b.count) for b, c in zip(blocks, common) if b)
    coded = context_coder.encode(arrays, common, 50_257)
    back = context_coder.decode(coded, [len(b) for b in blocks], common, 50_257)
    assert [b.tolist() for b in back] == blocks


@pytest.mark.parametrize("vocabulary", [50_257, 1 << 16, 100_000])
def test_ids_by_step_and_back(vocabulary):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, vocabulary, n).astype(np.int32) for n in sorted(rng.integers(0, 90, 150), reverse=True)] + [np.zeros(0, np.int32)]
    table = context_coder._by_step(rows, len(rows[0]), vocabulary)
    assert all(table[t, i] == x for i in (0, 63, 64, 149) for t, x in enumerate(rows[i]))
    assert [x.tolist() for x in context_coder._by_row(table, [len(r) for r in rows])] == [r.tolist() for r in rows]
    common = [context_coder.most_common(r) for r in rows]
    back = context_coder.decode(context_coder.encode(rows, common, vocabulary), [len(r) for r in rows], common, vocabulary)
    assert [x.tolist() for x in back] == [r.tolist() for r in rows]


def test_blocks_are_coded_independently_and_repetition_pays():
    rng = np.random.default_rng(1)
    loop, noise = np.tile(rng.integers(0, 50_000, 20), 100).astype(np.int32), rng.integers(0, 50_000, 2000).astype(np.int32)
    together, alone = context_coder.encode([loop, noise], [3, 4], 50_257), context_coder.encode([loop], [3], 50_257)
    assert together[0] == alone[0] and len(alone[0]) < 1500 < 3500 < len(together[1])


def test_carries_run_over_many_words():
    words, at = np.array([7, 2**32 - 1, 2**32 - 1, 5, 9], np.uint32), np.array([3, 5])
    context_coder._carry(words, at, np.array([0, 1]))
    assert words.tolist() == [8, 0, 0, 5, 10]


def test_damage_is_found():
    ids = np.arange(50, dtype=np.int32)
    (code,) = context_coder.encode([ids], [0], 50_257)
    block = token_file.pack_block(ids, code, context_coder.most_common(ids), 0, np.array([(1, 0, 50, 0)], token_file._ENTRY))
    assert token_file.unpack_blocks([block])[0][1].tolist() == ids.tolist()
    for at in (0, 9, 40, len(block) - 1):
        with pytest.raises(token_file.BlockError):
            token_file.unpack_blocks([block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :]])
    with pytest.raises(token_file.BlockError):
        token_file.unpack_blocks([block[:10]])


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_of_a_whole_from_its_parts(a, b):
    assert token_file.crc_after(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def read_back(spark, docs):
    path = shared_path(spark, "t")
    token_file.write_token_file(docs, path)
    return sorted(map(tuple, token_file.read_token_file(spark, path).collect()), key=lambda r: r[1])


def expected(rows):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_edges(spark, edges, empty, edge_rows):
    got = read_back(spark, edges)
    want = expected(edge_rows)
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in want)
    # No gaps and no overlaps; ids ascend.
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids) and got[0][0] is None
    assert read_back(spark, empty) == []


def test_long_documents_over_many_blocks(spark, make, prose):
    rows = [(i, prose(n, i)) for i, n in enumerate((1, 3000, 0, 700, 700, 700, 5000, 2))]
    assert read_back(spark, make(rows)) == expected(rows)
