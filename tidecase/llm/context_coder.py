"""Context-mixing range coder for token ids, many independent blocks side by side.

Each block starts from an empty model. The model foretells the next id three times: the id that last followed the two
ids before (order 2), the id that last followed the one id before (order 1), and the most frequent id
of the block, which its header names (order 0). How often each order was right, by how sure its entry is, is learned as the block goes and gives each
prediction its share of the interval; what is left is divided by a fixed law on the id's rank (byte-pair ids are ordered by
frequency of merging). A 64-bit range coder with carries turns shares into 32-bit words. Step ``t`` codes the ``t``-th id
of all blocks at once, so numpy's cost per call is shared; encoder and decoder run the same model code. A step does for all
blocks what an unforetold id needs, and sets right those few whose id was foretold.
"""

from __future__ import annotations

from functools import cache

import numpy as np

TOTAL_BITS = 21
PRIOR_BITS = 18
_FULL = np.uint64(1 << TOTAL_BITS)
_LEAST = np.uint64(1 << 32)
_TOTAL, _PRIOR, _WORD, _LOW = (np.uint64(x) for x in (TOTAL_BITS, PRIOR_BITS, 32, 0xFFFFFFFF))
#: A lane's table: 64 lines by the last id, of 8 entries of order 1 and 8 of order 2 each, so that a step reads one place of memory.
SLOTS = 1024
_LINE, _OF1, _OF2, _SECOND = (np.int32(x) for x in (0x3F0, 0x3F7, 7, 8))
_SPREAD = np.int32(40503)
#: Shares of order 2, 1 and 0 are fields of one number, so that one look-up reads them; in a step each loses 1/32 of itself, and the one that was
#: right gains 1/32 of the most that it can hold of the interval, which leaves 1/8 for other ids.
_SHARE, _RATE, _EACH = np.uint64(_FULL - np.uint64(1)), np.uint64(5), np.uint64(0xFFFF | 0xFFFF << TOTAL_BITS | 0xFFFF << 2 * TOTAL_BITS)
_FIELD1, _FIELD0 = np.uint64(TOTAL_BITS), np.uint64(2 * TOTAL_BITS)
_GAIN2, _GAIN1, _GAIN0 = np.uint64(9 << 12), np.uint64(4 << 12 << TOTAL_BITS), np.uint64(1 << 12 << 2 * TOTAL_BITS)
_AT_FIRST = 1 << 17 | 1 << 17 + TOTAL_BITS | 1 << 15 + 2 * TOTAL_BITS
_NONE = np.uint64(0)
#: Rows that are turned into steps at once.
_STRIP = 64


@cache
def _prior(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the ids, out of 2**18, in proportion to 1 / (id + 200) and 1 at least; and the id of each of the 2**18.

    A share is its start in the low 32 bits and its length in the high ones.
    """
    weight = 1.0 / (np.arange(vocabulary) + 200.0)
    spare = (1 << PRIOR_BITS) - vocabulary
    share = 1 + np.floor(weight / weight.sum() * spare).astype(np.int64)
    share[0] += (1 << PRIOR_BITS) - share.sum()
    return (np.cumsum(share) - share | share << 32).view(np.uint64), np.repeat(np.arange(vocabulary, dtype=np.int32), share)


class _Model:
    """State of all lanes; every array has one entry, or one row of a flat table, per lane."""

    def __init__(self, common: np.ndarray):
        lanes = len(common)
        n = np.arange(lanes)
        self.base, self.ctx_base = n * SLOTS, n * 16
        # id * 16 + sureness * 4 of order 2, id * 4 + sureness of order 1; lines begin where the machine's do
        room = np.zeros(lanes * SLOTS + 16, np.int32)
        self.after = room[-room.ctypes.data % 64 // 4 :][: lanes * SLOTS]
        self.right = np.full(lanes * 16, _AT_FIRST, np.uint64)  # learned shares
        self.common = common
        self.mixed = np.zeros(lanes, np.int32)
        self.slot1 = self.base.copy()
        self.slot2 = self.base + _SECOND

    def keep(self, k: int) -> None:
        """Only the first ``k`` lanes go on."""
        lanes = len(self.base)
        for name in ("base", "ctx_base", "after", "right", "common", "mixed", "slot1", "slot2"):
            x = getattr(self, name)
            setattr(self, name, x[: len(x) // lanes * k])

    def predict(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids that no order foretells begin, and the length of one of their 2**18 parts; ``part``: 1 / 2**21 of the interval."""
        self.e2, self.e1 = self.after[self.slot2], self.after[self.slot1]
        self.ctx = (self.e2 & 12 | self.e1 & 3) + self.ctx_base
        self.p, self.part = self.right.take(self.ctx), part
        top = self.p >> _FIELD1
        top &= _SHARE
        top += self.p & _SHARE
        top += self.p >> _FIELD0
        rest = _FULL - top
        rest *= part
        rest >>= _PRIOR
        top *= part
        return top, rest

    def foretold(self, lanes: np.ndarray) -> None:
        """Look closer at some lanes: ids that orders 2, 1, 0 foretell there, and the upper ends of their shares of the interval."""
        p, part = self.p[lanes], self.part[lanes]
        self.near2, self.near1 = self.e2[lanes], self.e1[lanes]
        self.of2, self.of1, self.of0 = self.near2 >> 4, self.near1 >> 2, self.common[lanes]
        low2, low1 = p & _SHARE, p >> _FIELD1 & _SHARE
        low1 += low2
        self.top2, self.top1, self.top0 = part * low2, part * low1, part * (low1 + (p >> _FIELD0))

    def update(self, ids: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learn the ids of all lanes; start and end of the intervals of those ``lanes``, of which ``foretold`` was asked, whose id some order foretold."""
        own = ids[lanes]
        hit2, same1 = self.of2 == own, self.of1 == own
        p = self.p
        p -= p >> _RATE & _EACH
        p[lanes] += np.where(hit2, _GAIN2, np.where(same1, _GAIN1, _GAIN0))
        self.right[self.ctx] = p
        # An entry that was right grows surer, from 1 to 3.
        fresh = ids << 2
        fresh |= 1
        entry = fresh << 2
        entry[lanes] += np.minimum(self.near2 & 12, 8) * hit2
        self.after[self.slot2] = entry
        fresh[lanes] += np.minimum(self.near1 & 3, 2) * same1
        self.after[self.slot1] = fresh
        now = ids * _SPREAD
        now >>= 4
        self.slot1 = (now & _OF1) + self.base
        self.mixed >>= 5
        self.mixed ^= now
        self.mixed &= _OF2
        self.mixed |= now & _LINE
        self.mixed |= _SECOND
        self.slot2 = self.mixed + self.base
        self.mixed = now
        return np.where(hit2, _NONE, np.where(same1, self.top2, self.top1)), np.where(hit2, self.top2, np.where(same1, self.top1, self.top0))


def most_common(ids: np.ndarray) -> int:
    """The id that order 0 foretells; the smallest among equals, 0 for no ids."""
    if not len(ids):
        return 0
    ranked = ids.astype(np.uint16 if ids.max() < 1 << 16 else ids.dtype)
    ranked.sort()
    ends = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), len(ranked) - 1)
    sizes = ends.copy()
    sizes[1:] -= ends[:-1]
    sizes[0] += 1
    return int(ranked[ends[sizes.argmax()]])


def _ends(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(first step, step after the last, lanes) over which the number of lanes stays; lengths fall."""
    steps = [0, *np.unique(lengths)]
    return [(a, b, int((lengths >= b).sum())) for a, b in zip(steps, steps[1:])]


def _by_step(rows: list[np.ndarray], steps: int, vocabulary: int) -> np.ndarray:
    """The ids of the ``rows`` step by step, so that a step reads one stretch of memory; made of ``_STRIP`` rows at a time, which stay near the machine."""
    out = np.empty((steps, len(rows)), _id_type(vocabulary))
    for a in range(0, len(rows), _STRIP):
        strip = np.zeros((min(_STRIP, len(rows) - a), steps), out.dtype)
        for own, row in zip(strip, rows[a : a + _STRIP]):
            own[: len(row)] = row
        out[:, a : a + _STRIP] = strip.T
    return out


def _by_row(table: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """``_by_step`` turned back."""
    out = []
    for a in range(0, len(lengths), _STRIP):
        strip = np.ascontiguousarray(table[:, a : a + _STRIP].T)
        out += [row[:n].astype(np.int32) for row, n in zip(strip, lengths[a : a + _STRIP])]
    return out


def _id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.int32


def encode(blocks: list[np.ndarray], common: list[int], vocabulary: int) -> list[bytes]:
    """One byte string per block of ids below ``vocabulary``; ``common``: the ``most_common`` id of each."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    lanes, steps = len(order), int(lengths.max(initial=0))
    if not steps:
        return [b""] * lanes
    shares, _ = _prior(vocabulary)
    table = _by_step([blocks[i] for i in order], steps, vocabulary)
    starts = np.arange(lanes) * (steps + 2)
    words, at = np.zeros(lanes * (steps + 2), np.uint32), starts.copy()  # what each lane has sent, and where its next word goes
    model = _Model(np.array([common[i] for i in order], np.int32))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(2**64 - 1))
    final = np.zeros(lanes, np.uint64)
    for first, last, k in _ends(lengths):
        final[k : len(low)] = low[k:]
        low, span = low[:k], span[:k]
        model.keep(k)
        for t in range(first, last):
            ids = table[t, :k].astype(np.int32)
            add, span = model.predict(span >> _TOTAL)
            share = shares.take(ids)
            add += span * (share & _LOW)
            span *= share >> _WORD
            hits = np.flatnonzero((model.e2 >> 4 == ids) | (model.e1 >> 2 == ids) | (model.common == ids))
            model.foretold(hits)
            start, end = model.update(ids, hits)
            add[hits] = start
            span[hits] = end - start
            low += add
            _carry(words, at, np.flatnonzero(low < add))
            need = np.flatnonzero(span < _LEAST)
            full, to = low[need], at[need]
            words[to] = full >> _WORD
            at[need] = to + 1
            low[need] = full << _WORD
            span[need] <<= _WORD
    final[: len(low)] = low
    words[at], words[at + 1] = final >> _WORD, final & _LOW
    out: list[bytes] = [b""] * lanes
    for i, n, a, b in zip(order, lengths, starts.tolist(), (at + 2).tolist()):
        out[i] = words[a:b].astype(">u4").tobytes() if n else b""
    return out


def _carry(words: np.ndarray, at: np.ndarray, lanes: np.ndarray) -> None:
    """Add 1 to what the ``lanes`` have sent: to the last word, and to the one before where a word runs over."""
    last = at[lanes] - 1
    while len(last):
        words[last] += np.uint32(1)
        last = last[words[last] == 0] - 1


def decode(parts: list[bytes], lengths: list[int], common: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids that ``encode`` was given; ``lengths``, ``common``: how many in each block, and its ``most_common`` id."""
    order = sorted(range(len(parts)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    lanes, steps = len(order), int(sizes.max(initial=0))
    if not steps:
        return [np.zeros(0, np.int32)] * lanes
    shares, inverse = _prior(vocabulary)
    buffers = [np.frombuffer(parts[i], ">u4") for i in order]
    starts = np.cumsum([0, *(len(b) + 2 for b in buffers)])
    stream = np.zeros(starts[-1] + 2, np.uint32)
    for b, s in zip(buffers, starts):
        stream[s : s + len(b)] = b
    at = starts[:-1].copy()
    code = stream[at].astype(np.uint64) << _WORD | stream[at + 1]
    at += 2
    span = np.full(lanes, np.uint64(2**64 - 1))
    table = np.empty((steps, lanes), _id_type(vocabulary))  # ids step by step
    model = _Model(np.array([common[i] for i in order], np.int32))
    last_part = np.uint64((1 << PRIOR_BITS) - 1)
    for first, last, k in _ends(sizes):
        code, span = code[:k], span[:k]
        model.keep(k)
        for t in range(first, last):
            top, span = model.predict(span >> _TOTAL)
            hits = np.flatnonzero(code < top)
            rest = code - top
            ids = inverse.take(np.minimum(rest // span, last_part).view(np.int64))
            model.foretold(hits)
            own = code[hits]
            ids[hits] = np.where(own < model.top2, model.of2, np.where(own < model.top1, model.of1, model.of0))
            table[t, :k] = ids
            share = shares.take(ids)
            rest -= span * (share & _LOW)
            span *= share >> _WORD
            start, end = model.update(ids, hits)
            rest[hits] = own - start
            span[hits] = end - start
            need = np.flatnonzero(span < _LEAST)
            to = at[need]
            rest[need] = rest[need] << _WORD | stream.take(to)
            at[need] = to + 1
            span[need] <<= _WORD
            code = rest
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * lanes
    for i, ids in zip(order, _by_row(table, sizes.tolist())):
        out[i] = ids
    return out
