"""Repair of conversations whose turns are out of order, doubled, cut off or missing: a generalised LR parse with edits.

The roles of a sound conversation are a sentence of ``GRAMMAR``: an optional system turn, then user and assistant turns in pairs, or nothing. The parser reads
the rows of a conversation with a graph-structured stack over the grammar's LR automaton. Every row may be kept, given another role, or
deleted, and turns may be inserted before it; each action leads from a stack top to others, and where two ways lead to equal tops only the one of least
(cost, audit) goes on. The audit has one letter for each edit, in order.

Rows are sorted by ranges of (conversation, turn), so a conversation of any share of all rows is spread over tasks. A task parses what it has of a
conversation in chunks of bounded size. For the chunks of a conversation that goes over the borders of tasks or chunks it parses from every stack a chunk can start with and keeps the cheapest
way to each stack it can end with; these small tables are then chained. Only the hash of a repaired conversation, which is one sequence by its nature,
runs in one task for each conversation, as a stream over its chunks.

Nulls in any column read as one space; a null conversation id is a conversation of its own, and null turns come first and have no part in
gaps. Turns with equal numbers are ordered by role and text, so repeated rows stand together. Texts are taken whole. A
conversation of which nothing is left keeps its row. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidecase.llm.common import partitions, table, written

#: Left sides and right sides; lower-case letters are initials of roles.
GRAMMAR = (("Talk", ""), ("Talk", "Pairs"), ("Pairs", "Open u a"), ("Pairs", "Pairs u a"), ("Open", ""), ("Open", "s"))
ROLES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: A chunk ends at so many rows or characters of text.
CHUNK_ROWS, CHUNK_CHARS = 50_000, 8_000_000
FAULTS = ("blank", "duplicate", "truncated")


# ---- the grammar's automaton


def _closure(items: frozenset) -> frozenset:
    todo, out = list(items), set(items)
    while todo:
        rule, dot = todo.pop()
        rest = GRAMMAR[rule][1].split()[dot:]
        for i, (left, _) in enumerate(GRAMMAR):
            if rest and left == rest[0] and (i, 0) not in out:
                out.add((i, 0))
                todo.append((i, 0))
    return frozenset(out)


@cache
def _goto(state: frozenset, symbol: str) -> frozenset:
    return _closure(frozenset((r, d + 1) for r, d in state if GRAMMAR[r][1].split()[d : d + 1] == [symbol]))


START = _closure(frozenset((i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == "Talk"))
END = "$"


@cache
def _follow() -> dict[str, set[str]]:
    """What may follow a left side; no left side that can be empty is in front of another one here."""
    follow: dict[str, set[str]] = {"Talk": {END}, "Pairs": set(), "Open": set()}
    for _ in GRAMMAR:
        for left, right in GRAMMAR:
            symbols = right.split()
            for symbol, after in zip(symbols, [*symbols[1:], None]):
                if symbol in follow:
                    follow[symbol] |= follow[left] if after is None else {after}
    return follow


@cache
def moved(stack: tuple, symbol: str) -> tuple | None:
    """The stack after the reductions that ``symbol`` asks for and its shift; None if it can't come here.

    Stacks are nested pairs (state, stack below), so equal tops share what is below them. Reductions come before the shift as well as
    behind it, so a stack stands for all that was read and equal tops mean equal futures.
    """
    for _ in range(len(GRAMMAR) + 1):
        shifted = _goto(stack[0], symbol)
        if shifted:
            return _reduced((shifted, stack))
        done = [r for r, d in stack[0] if d == len(GRAMMAR[r][1].split()) and symbol in _follow()[GRAMMAR[r][0]] and GRAMMAR[r][0] != "Talk"]
        if not done:
            return None
        stack = _popped(stack, done[0])
    return None


def _popped(stack: tuple, rule: int) -> tuple:
    left, right = GRAMMAR[rule]
    for _ in right.split():
        stack = stack[1]
    return (_goto(stack[0], left), stack)


def _reduced(stack: tuple) -> tuple:
    """Reductions that are the only thing a top allows."""
    while len(stack[0]) == 1 and (rule := next(iter(stack[0])))[1] == len(GRAMMAR[rule[0]][1].split()) and GRAMMAR[rule[0]][0] != "Talk":
        stack = _popped(stack, rule[0])
    return stack


@cache
def accepted(stack: tuple) -> bool:
    return any(GRAMMAR[r][0] == "Talk" and d == len(GRAMMAR[r][1].split()) for r, d in stack[0])


@cache
def stacks() -> tuple[tuple, ...]:
    """All stacks there are between rows; left recursion keeps them few. The first is that of the start."""
    found = [(START, None)]
    for s in found:
        found += [t for c in ("s", *ROLES) if (t := moved(s, c)) is not None and t not in found]
    return tuple(found)


@cache
def number(stack: tuple) -> int:
    return stacks().index(stack)


@cache
def inserted(stack: tuple) -> tuple[tuple[str, tuple], ...]:
    """Roles inserted at a stack, with the stack they lead to; none comes back to a stack that it was at."""
    found = [("", stack)]
    for roles, s in found:
        for c in ROLES:
            if (t := moved(s, c)) is not None and all(t != known for _, known in found):
                found.append((roles + c, t))
    return tuple(found)


@cache
def steps(top: int, initial: str, truncated: bool) -> tuple[tuple[int, int, str, str], ...]:
    """What may be done with a row that need not be deleted: (next top, cost, letters, role given); inserts come first, if any.

    An insert in front of a deletion is left to the next row, where it makes a lesser audit at the same cost.
    """
    late = CUT_OFF * truncated
    out = [(top, DELETE, "D", "")]
    for roles, stack in inserted(stacks()[top]):
        cost, letters = INSERT * len(roles), "I" * len(roles)
        if (t := moved(stack, initial) if initial in ("s", *ROLES) else None) is not None:
            out.append((number(t), cost + late, letters + "K", ""))
        out += [(number(t), cost + REROLE + late, letters + "R", ROLES[c]) for c in ROLES if (t := moved(stack, c)) is not None]
    return tuple(out)


@cache
def endings(top: int) -> tuple[int, str] | None:
    """Cheapest inserts with which a conversation may end at a top: cost and letters."""
    found = [(INSERT * len(roles), "I" * len(roles)) for roles, s in inserted(stacks()[top]) if accepted(s)]
    return min(found, default=None)


# ---- parsing rows


class Parse:
    """Stack tops over rows read one by one, from one stack; a way back is kept for each row and top.

    Of two ways to equal tops the lesser (cost, audit) stays. Audits are compared by the rank of what they had before the row and the row's
    letters: each ends with the letter of a row, so none of equal length in rows is the beginning of another.
    """

    def __init__(self, top: int):
        self.tops: dict[int, tuple[int, int]] = {top: (0, 0)}  # cost, rank of the audit
        self.back: list[dict[int, tuple[int, str]]] = []

    def read(self, initial: str, truncated: bool, gone: int, kept: bool) -> None:
        """A row that ``gone`` rows which must be deleted follow; not ``kept``: it must be deleted itself."""
        best: dict[int, tuple[int, int, str, int]] = {}
        more = "D" * gone
        for top, (cost, rank) in self.tops.items():
            for to, price, letters, _ in steps(top, initial, truncated) if kept else ((top, DELETE, "D", ""),):
                way = (cost + price + DELETE * gone, rank, letters + more, top)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        ranks = {audit: i for i, audit in enumerate(sorted({w[1:3] for w in best.values()}))}
        self.tops = {to: (w[0], ranks[w[1:3]]) for to, w in best.items()}
        self.back.append({to: (w[3], w[2]) for to, w in best.items()})

    def audit(self, top: int) -> list[str]:
        """The letters of each row on the way to a top."""
        out = []
        for ways in reversed(self.back):
            top, letters = ways[top]
            out.append(letters)
        return out[::-1]


def least_end(tops: dict[int, tuple[int, int]]) -> tuple[int, int, str] | None:
    """The cheapest top to end at: top, cost, letters inserted."""
    ends = [(cost + e[0], rank, e[1], top) for top, (cost, rank) in tops.items() if (e := endings(top)) is not None]
    return (lambda m: (m[3], m[0], m[2]))(min(ends)) if ends else None


def lines(rows: list[tuple[str, str]], audit: list[str], top: int) -> Iterator[str]:
    """The repaired turns of rows of (role, text) whose letters are ``audit``, from a top."""
    stack = stacks()[top]

    def place(wish: str) -> str:
        nonlocal stack
        c = wish if wish else next(c for c in ROLES if moved(stack, c) is not None)
        stack = moved(stack, c)
        return c

    for (role, text), letters in zip(rows, audit):
        for letter in letters:
            if letter == "I":
                yield ROLES[place("")] + ":"
            elif letter == "R":
                yield f"{ROLES[place('')]}:{text}"
            elif letter == "K":
                place(role[:1])
                yield f"{role}:{text}"


def closing(letters: str, top: int) -> Iterator[str]:
    yield from lines([("", "")], [letters], top)


def fault_of(text: str, again: bool) -> str:
    bare = text.rstrip(SPACES)
    return "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else ""


# ---- chunks of a conversation

_PAIR = "su ua au".split()
_SUMS = ("rows", *FAULTS, "illegal", "distinct")


class Chunk:
    """Consecutive rows of one conversation, with what is needed to go on at its borders."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.counts, self.chars = conv_id, [], dict.fromkeys(_SUMS, 0), 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        """``copies`` equal rows; ``again``: the conversation has role and text at an earlier turn."""
        if copies == 0:  # all of them were dropped
            return
        c, fault = self.counts, fault_of(text, again)
        if fault:
            c[fault] += 1
        if copies > 1:
            c["blank" if fault == "blank" else "duplicate"] += copies - 1
        initial = role[:1]
        pairs = [(self.last_role, 1)] if c["rows"] else []
        c["illegal"] += sum(n for before, n in [*pairs, (initial, copies - 1)] if before + initial not in _PAIR)
        c["distinct"] += turn is not None and turn != self.last_turn
        if c["rows"] == 0:
            self.first_role = initial
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.last_role = initial
        c["rows"] += copies
        self.rows.append((role, text, fault, copies))
        self.chars += len(text) + copies

    def full(self, rows: int, chars: int) -> bool:
        return len(self.rows) >= rows or self.chars >= chars

    def parsed(self, top: int) -> Parse:
        parse = Parse(top)
        for role, _, fault, copies in self.rows:
            parse.read(role[:1], fault == "truncated", copies - 1, fault not in ("blank", "duplicate"))
        return parse

    def turns(self) -> list[tuple[str, str]]:
        return [(role, text) for role, text, _, _ in self.rows]

    def whole(self) -> dict:
        """The result of a conversation that is this chunk."""
        parse = self.parsed(0)
        top, cost, letters = least_end(parse.tops)
        audit = parse.audit(top)
        out = [*lines(self.turns(), audit, 0), *closing(letters, top)]
        return result(self.conv_id, self.counts, (self.first_turn, self.last_turn), cost, "".join(audit) + letters, sha256("\n".join(out).encode()).hexdigest())

    def part(self, task: int, seq: int) -> dict:
        """A row of the table of chunks: ways from each stack to each other, and the rows."""
        ways = []
        for top in range(len(stacks())):
            parse = self.parsed(top)
            ways += [{"of": top, "to": to, "cost": cost, "rank": rank, "audit": parse.audit(to)} for to, (cost, rank) in parse.tops.items()]
        ends = {"first_role": self.first_role, "last_role": self.last_role, "first_turn": self.first_turn, "last_turn": self.last_turn}
        return {"conv_id": self.conv_id, "task": task, "seq": seq, **self.counts, **ends, "ways": ways, "turns": [{"role": r, "text": t} for r, t in self.turns()]}


def result(conv_id, counts: dict, span: tuple, cost: int, audit: str, digest: str) -> dict:
    gaps = 0 if span[0] is None else span[1] - span[0] + 1 - counts["distinct"]
    return {"conv_id": conv_id, "gaps": min(gaps, 2**63 - 1), **{k: counts[k] for k in (*FAULTS, "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


_RESULT = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", *FAULTS, "illegal", "cost")] + [(c, pa.string()) for c in ("audit", "repaired_sha256")])
_WAY = pa.struct([("of", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.list_(pa.string()))])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_PART = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in _SUMS], ("first_role", pa.string()), ("last_role", pa.string())]
    + [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("ways", pa.list_(_WAY)), ("turns", pa.list_(_TURN))]
)
_READ = pa.schema([("result", pa.struct(list(_RESULT))), ("part", pa.struct(list(_PART)))])
RESULT, READ = from_arrow_schema(_RESULT), from_arrow_schema(_READ)


def _read(chunk_rows: int, chunk_chars: int):
    """Results of the conversations that lie within the task, and chunks of the first and last one and of those over the bounds of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        done: list[dict] = []
        parts: list[dict] = []
        chunk, split, first = None, False, True

        def flush(force: bool = False) -> Iterator[pa.RecordBatch]:
            if done and (force or len(done) >= 2_000) or parts:
                results = [{"result": r, "part": None} for r in done] + [{"result": None, "part": p} for p in parts]
                yield pa.RecordBatch.from_pylist(results, schema=_READ)
                done.clear()
                parts.clear()

        def close(as_part: bool) -> None:
            nonlocal seq
            if as_part:
                parts.append(chunk.part(task, seq))
                seq += 1
            else:
                done.append(chunk.whole())

        for batch in batches:
            for conv_id, turn, role, text, copies, again in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None or conv_id != chunk.conv_id:
                    if chunk is not None:
                        close(split or first)
                        first = False
                        yield from flush()
                    chunk, split = Chunk(conv_id), False
                elif chunk.full(chunk_rows, chunk_chars):
                    close(True)
                    yield from flush()
                    chunk, split = Chunk(conv_id), True
                chunk.add(turn, role, text, copies, again)
        if chunk is not None:
            close(True)
        yield from flush(True)

    return run


def _chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a conversation the stack it starts with and the one it ends with, and the conversation's sums."""
    pdf = pdf.sort_values(["task", "seq"])
    chunks = [r._asdict() for r in pdf.itertuples(index=False)]
    tops, back = {0: (0, 0)}, []
    counts, last_role, first_turn, last_turn = dict.fromkeys(_SUMS, 0), None, None, None
    for c in chunks:
        for k in _SUMS:
            counts[k] += int(c[k])
        if c["rows"]:
            counts["illegal"] += last_role is not None and last_role + c["first_role"] not in _PAIR
            last_role = c["last_role"]
        if not pd.isna(c["first_turn"]):
            counts["distinct"] -= last_turn is not None and last_turn == int(c["first_turn"])
            first_turn = int(c["first_turn"]) if first_turn is None else first_turn
            last_turn = int(c["last_turn"])
        best: dict[int, tuple] = {}
        for w in c["ways"]:
            if w["of"] in tops:
                cost, rank = tops[w["of"]]
                way = (cost + w["cost"], rank, w["rank"], w["of"])
                if w["to"] not in best or way < best[w["to"]]:
                    best[w["to"]] = way
        ranks = {audit: i for i, audit in enumerate(sorted({(x[1], x[3], x[2]) for x in best.values()}))}
        tops = {to: (x[0], ranks[x[1], x[3], x[2]]) for to, x in best.items()}
        back.append({to: x[3] for to, x in best.items()})
    top, cost, letters = least_end(tops)
    out = []
    for c, ways in zip(reversed(chunks), reversed(back)):
        out.append({"task": c["task"], "seq": c["seq"], "of": ways[top], "to": top, "last": not out})
        top = ways[top]
    sums = result(None, counts, (first_turn, last_turn), cost, letters, "")
    return pd.DataFrame([{**o, **{k: sums[k] for k in ("gaps", *FAULTS, "illegal", "cost")}, "letters": letters} for o in out])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result per conversation from its chunks in order; the text passes through the hash chunk by chunk."""
    now, audit, digest, lines_out, last = None, [], sha256(), 0, None

    def feed(more: Iterator[str]) -> None:
        nonlocal lines_out
        for line in more:
            digest.update(("\n" * (lines_out > 0) + line).encode())
            lines_out += 1

    def close() -> pa.RecordBatch:
        feed(closing(last["letters"], last["to"]))
        row = {k: last[k] for k in ("conv_id", "gaps", *FAULTS, "illegal", "cost")}
        return pa.RecordBatch.from_pylist([{**row, "audit": "".join(audit) + last["letters"], "repaired_sha256": digest.hexdigest()}], schema=_RESULT)

    for batch in batches:
        for at in range(batch.num_rows):
            c = batch.slice(at, 1).to_pylist()[0]
            if now is not None and (c["conv_id"],) != now:
                yield close()
                audit, digest, lines_out = [], sha256(), 0
            now, last = (c["conv_id"],), c
            feed(lines([(t["role"], t["text"]) for t in c["turns"]], c["audit"], c["of"]))
            audit.append("".join(c["audit"]))
    if now is not None:
        yield close()


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per ``conv_id`` of ``turns(conv_id, turn, role, text, copies)``: faults, cheapest edits and the hash of the repaired text.

    ``copies``: how often a row stands there; rows of 0 copies only keep their conversation in the result.
    """
    spark = turns.sparkSession
    by = ["conv_id", "turn", "role", "text"]
    same = turns.groupBy(*by).agg(F.sum("copies").cast("long").alias("copies"))
    digest = F.unhex(F.sha2("text", 256))
    marked = same.withColumns({"_text": F.when((F.col("copies") > 0) & ~F.rlike("text", F.lit(r"\A[ \t-\r]*\z")), digest), "_turn": F.struct("turn")})
    first = marked.filter("_text is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_same"))
    first = first.agg(F.min("_turn").alias("_first"), F.count("*").alias("_turns")).filter("_turns > 1")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_same"))
    rows = marked.join(first, on, "left").select(*by, "copies", F.coalesce(F.col("_turn") > F.col("_first"), F.lit(False)).alias("again"))
    order = [F.col(c).asc_nulls_first() for c in by]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    read = written(ranged.mapInArrow(_read(chunk_rows, chunk_chars), READ), "turn-repair")
    parts = read.filter("part is not null").select("part.*")
    small = F.transform("ways", lambda w: F.struct(*[w[k].alias(k) for k in ("of", "to", "cost", "rank")])).alias("ways")
    turn_text = [F.col(c).cast("string").alias(c) for c in ("first_turn", "last_turn")]  # pandas has no whole numbers beside nulls
    table_of = parts.select("conv_id", "task", "seq", *_SUMS, "first_role", "last_role", *turn_text, small)
    sums = ", ".join(f"{c} long" for c in ("gaps", *FAULTS, "illegal", "cost"))
    chosen = table_of.groupBy("conv_id").applyInPandas(_chained, f"task int, seq int, of int, to int, last boolean, {sums}, letters string")
    way: Column = F.filter("ways", lambda w: (w["of"] == F.col("of")) & (w["to"] == F.col("to")))[0]["audit"]
    ways = parts.select("conv_id", "task", "seq", "ways", "turns").join(chosen, ["task", "seq"])
    picked = ways.select("conv_id", "task", "seq", "of", "to", "gaps", *FAULTS, "illegal", "cost", "letters", way.alias("audit"), "turns")
    streams = picked.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq")
    return read.filter("result is not null").select("result.*").unionByName(streams.mapInArrow(_joined, RESULT))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows dropped, emptied, cut off, repeated or given to the user, by the hash of their place."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
