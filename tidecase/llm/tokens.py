"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

A text is cut before each space and around each line feed. Where no two white-space characters stand together, the
tokenizer's own split pattern has borders there too, so the ids of the pieces, one after the other, are the ids of the
text. Pieces repeat, so their ids are kept in a bounded table. Any other text goes to the tokenizer as a whole, as does one that holds the
string of an added token, which the tokenizer gives that token's id.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from tidecase.llm.common import worker_cache

DEFAULT_FILE = "byte_bpe_50k.json"
#: What must be absent for cutting: white space side by side, white space of other kinds, the mark used for cutting.
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_OTHERS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\x00"
#: Bytes of texts whose pieces are told apart at once.
GROUP_BYTES = 16 << 20
#: Texts of a group whose ids are put together at once.
GATHERED = 512
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ONE_WORD = f"^ ?[{_LETTERS}]+$"
_WORD = re.compile(rf"( ?[{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")


def _kinds() -> np.ndarray:
    """Of a byte: 1 where a piece begins at it, 4 where one begins behind it, 8 for a letter, 16 for a mark, 32 and 64 for the two bytes of a letter."""
    kinds = np.zeros(256, np.uint8)
    for c in map(chr, range(128)):
        kinds[ord(c)] = 1 * (c in " \n") | 4 * (c == "\n") | 8 * c.isalpha() | 16 * (c.isprintable() and c != " " and not c.isalnum())
    for c in filter(str.isalpha, map(chr, range(0xC0, 0x100))):
        first, second = c.encode()
        kinds[first], kinds[second] = 32, 64
    return kinds


_KINDS = _kinds()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class TextEncoder(dict):
    """Maps a piece of text to its ids as little-endian 32-bit integers; at most 1.5 times ``remembered`` pieces are kept, and twice as many short words of columns."""

    def __init__(self, file: str | None = None, remembered: int = 500_000):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(file or tokenizer_path(DEFAULT_FILE))
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model, self._alphabet, self._remembered = self._tokenizer.model, _byte_letters(), remembered
        self._alphabet_of_lines = {b: c for b, c in self._alphabet.items() if b != ord("\n")}
        self._words = _ShortWords()
        self._with_marks: dict[str, bytes] = {}  # words with punctuation behind them; they must not crowd out words

    def __missing__(self, piece: str) -> bytes:
        ids = self._with_marks.get(piece)
        if ids is not None:
            return ids
        word = _WORD.fullmatch(piece)
        if word is None:
            ids = self._whole(piece)
        elif word[2]:
            ids = self[word[1]] + self[word[2]]
        else:
            letters = piece.encode().decode("latin-1").translate(self._alphabet)
            ids = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
        kept, most = (self, self._remembered) if word and not word[2] else (self._with_marks, self._remembered // 2)
        if len(kept) < most:
            kept[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _can_be_cut(self, text: str) -> bool:
        return not (any(x in text for x in self._added) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS) or any(x in text for x in _OTHERS))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._can_be_cut(text):
            return self._whole(text)
        pieces = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        return b"".join(map(self.__getitem__, pieces))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """What ``encode`` gives for each of ``texts``, a null counting as empty; a piece is looked up once for each ``GROUP_BYTES`` of texts."""
        ends = np.cumsum(np.append(0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + GROUP_BYTES, "right")) - 1)
            yield from self._encode_group(texts.slice(a, b - a).to_pylist())
            a = b

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        cut, data = [], []
        for i, text in enumerate(texts):
            if text:
                if self._can_be_cut(text):
                    cut.append(i)
                    data.append(text.encode())
                else:
                    out[i] = self._whole(text)
        if not cut:
            return out
        first = np.cumsum([0, *map(len, data)])  # of each text, and the end
        letters = np.frombuffer(b"".join(data), np.uint8)
        at = _borders(letters, first[:-1])
        pieces = pa.Array.from_buffers(pa.large_utf8(), len(at), [None, pa.py_buffer(np.append(at, len(letters))), pa.py_buffer(letters)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        sizes, starts, ids = self._ids_of_pieces(pieces.dictionary)
        stops = np.searchsorted(at, first[1:]).tolist()  # of each text in the pieces
        for a in range(0, len(cut), GATHERED):
            texts_, ends_ = cut[a : a + GATHERED], stops[a : a + GATHERED]
            begin = stops[a - 1] if a else 0
            some = which[begin : ends_[-1]]
            own = sizes[some]
            ends = np.cumsum(own)
            place = np.repeat(starts[some] - ends + own, own)
            place += np.arange(len(place))
            found = ids[place].tobytes()
            own_ends = [4 * int(ends[e - begin - 1]) for e in ends_]
            for i, b, e in zip(texts_, [0, *own_ends], own_ends):
                out[i] = found[b:e]
        return out

    def _ids_of_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each piece has and where they begin, and the ids. Of the new ones, single words are put into the byte-level alphabet side by side."""
        low, high, short = _bytes_of(distinct)
        known, starts, sizes = self._words.find(low, high)
        new = np.flatnonzero(~(known & short))
        fresh = distinct.take(pa.array(new))
        single = pc.match_substring_regex(fresh, _ONE_WORD).to_numpy(zero_copy_only=False)
        pieces = fresh.to_numpy(zero_copy_only=False)
        lines, model = "\n".join(pieces[single]), self._model.tokenize
        words = [[t.id for t in model(x)] for x in lines.encode().decode("latin-1").translate(self._alphabet_of_lines).split("\n")] if lines else []
        others = [self[x] for x in pieces[~single]]
        own = np.append(np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, others), np.int64, len(others)) // 4)
        word_ids = np.fromiter(chain.from_iterable(words), np.uint32, int(own[: len(words)].sum()))
        ids = np.concatenate([self._words.ids, word_ids, np.frombuffer(b"".join(others), "<u4")])
        order = np.append(new[single], new[~single])
        sizes[order], starts[order] = own, len(self._words.ids) + np.cumsum(own) - own
        kept = new[single & short[new]][: max(0, 2 * self._remembered - len(self._words.hashes))]
        if len(kept):
            self._words.add(low[kept], high[kept], starts[kept], sizes[kept], ids[: len(self._words.ids) + len(word_ids)])
        return sizes, starts, ids


class _ShortWords:
    """Where the ids of words of 16 bytes at most are, in the order of hashes of the bytes; the bytes are compared too."""

    def __init__(self):
        self.hashes, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.uint32)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word whether it is here, and if so where its ids begin and how many they are."""
        if not len(self.hashes):
            return np.zeros(len(low), bool), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        hashes = _hashed(low, high)
        order = np.argsort(hashes)
        at = np.empty(len(low), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        np.minimum(at, len(self.hashes) - 1, out=at)
        return (self.low[at] == low) & (self.high[at] == high), self.starts[at], self.sizes[at].astype(np.int64)

    def add(self, low: np.ndarray, high: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """``ids``: those here and the new ones behind them."""
        self.ids = ids
        order = np.argsort(np.append(self.hashes, _hashed(low, high)))
        for name, new in (("hashes", _hashed(low, high)), ("low", low), ("high", high), ("starts", starts), ("sizes", sizes)):  # one by one, to hold little at a time
            setattr(self, name, np.append(getattr(self, name), new.astype(getattr(self, name).dtype))[order])


def _hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mixed = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 bytes of each string and the next 8 as numbers, zeros behind its end; and whether that is all of it. Strings that differ, without zero bytes, have other numbers then."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    first, sizes = ends[:-1], np.diff(ends)
    data = (strings.buffers()[2].to_pybytes() if len(strings) else b"") + bytes(16)
    every = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    return every[first] & masks[np.minimum(sizes, 8)], every[first + 8] & masks[np.clip(sizes - 8, 0, 8)], sizes <= 16


def _borders(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, whose bytes stand side by side: at each text, space and line feed, behind a line feed, and between a letter of Latin-1 and an ASCII mark.

    The tokenizer's split pattern takes no mark into the run of a letter, so it has a border there whatever follows.
    """
    kind = _KINDS[letters]
    begins = kind & 1
    behind = kind[:-1] & (kind[1:] >> 1 & 8 | 4)  # a letter before a mark; a line feed before anything
    begins[1:] |= behind >> 2 | behind >> 3
    begins[2:] |= kind[:-2] >> 5 & kind[1:-1] >> 6 & kind[2:] >> 4  # a letter of two bytes before a mark
    begins[first] = 1
    return np.flatnonzero(begins)


def shared_encoder(file: str | None = None) -> TextEncoder:
    """One encoder per Python worker: its remembered pieces serve the worker's tasks until another operator's come."""
    return worker_cache(f"tokens {file}", lambda: TextEncoder(file))
