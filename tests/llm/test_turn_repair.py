import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from tidecase.llm import turn_repair

SOUND = re.compile(r"(s?(ua)+)?\Z")
#: Beginnings of sound sequences fall into these classes; what may follow depends on the class alone.
CLASS = ((re.compile(r"\Z"), 0), (re.compile(r"s\Z"), 1), (re.compile(r"s?(ua)*u\Z"), 2), (re.compile(r"s?(ua)+\Z"), 3))


def class_of(roles):
    return next((c for pattern, c in CLASS if pattern.match(roles)), None)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying all edits, with whole audits kept for each class of role sequences."""
    ways = {0: (0, "", ())}

    def with_inserts(ways):
        for _ in range(4):
            for cost, audit, turns in list(ways.values()):
                for role in ("user", "assistant"):
                    more = (*turns, f"{role}:")
                    c = class_of("".join(t[:1] for t in more))
                    if c is not None:
                        ways[c] = min(ways.get(c, (1e9,)), (cost + 5, audit + "I", more))
        return ways

    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for cost, audit, turns in with_inserts(dict(ways)).values():
            edits = [(2, "D", turns)]
            if fault in ("", "truncated"):
                late = 5 * (fault == "truncated")
                edits.append((late, "K", (*turns, f"{role}:{text}")))
                edits += [(1 + late, "R", (*turns, f"{r}:{text}")) for r in ("user", "assistant")]
            for price, letter, more in edits:
                initials = "".join("~" if t.startswith(":") else t[:1] for t in more)
                c = class_of(initials)
                if c is not None:
                    new[c] = min(new.get(c, (1e9,)), (cost + price, audit + letter, more))
        ways = new
    return min(w for c, w in with_inserts(ways).items() if c in (0, 3))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = after_damage([r for r in rows if r[0] == conv])
        found, turns = faults(left), [r[0] for r in left if r[0] is not None]
        cost, audit, repaired = cheapest(left)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in turn_repair.FAULTS), illegal, cost, audit, sha256("\n".join(repaired).encode()).hexdigest())
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "conv_id long, turn long, role string, text string, copies string, again string")
    return {r[0]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damaged(df), **more).select("conv_id", "gaps", *turn_repair.FAULTS, "illegal", "cost", "audit", "repaired_sha256").collect()}


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "a\nb. ", "x.\t", "", " ", "漢。", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown", "", None]
    return [
        (conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 7 - (rng.random() < 0.1), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randint(0, 30)}.")
        for conv in range(count) for turn in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("seed, count, longest, chunk", [(1, 150, 9, 50_000), (2, 20, 60, 50_000), (3, 3, 300, 7), (4, 40, 6, 1)])
def test_like_trying_all_edits(spark, seed, count, longest, chunk):
    rows = conversations(seed, count, longest)
    assert got(spark, rows, chunk_rows=chunk) == expected(rows)


def test_edges(spark):
    wide = "word " * 50_000 + "end."
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, None, "user", "Hi."), (1, 5, "user", wide), (1, 6, "assistant", wide), (2, -9, "user", ""), (2, 2**40, "assistant", "x")]
    rows += [(7, 4, "user", "Same.")] * 50 + [(7, t, "assistant", "Same.") for t in range(60)] + [(c, 0, "user", "Once.") for c in range(100, 160)]
    assert got(spark, rows) == expected(rows) and got(spark, rows, chunk_chars=40) == expected(rows)
    assert got(spark, []) == {}


def test_given_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = {r[0]: tuple(r)[1:] for r in turn_repair.repaired_conversations(spark, data).collect()}
    assert result == expected(rows)


def test_automaton():
    for n in range(6):
        for roles in map("".join, itertools.product("sua", repeat=n)):
            stack = turn_repair.stacks()[0]
            for c in roles:
                stack = stack and turn_repair.moved(stack, c)
            assert bool(stack and turn_repair.accepted(stack)) == bool(SOUND.match(roles)), roles
    assert len(turn_repair.stacks()) == 5
