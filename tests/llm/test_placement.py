from collections import Counter

import pytest

from tidecase.llm import placement


def filled(names, slots, turns=None):
    """The plain loop: shards in turn, each claims its first free slot."""
    import hashlib

    digest = [hashlib.md5(s.encode()).hexdigest() for s in names]
    offsets, steps = [int(d[:12], 16) % slots for d in digest], [int(d[12:24], 16) % (slots - 1) + 1 for d in digest]
    order, tried, out, turn = turns or list(range(len(names))), [0] * len(names), [None] * slots, 0
    for _ in range(slots):
        s = order[turn % len(order)]
        while out[slot := (offsets[s] + tried[s] * steps[s]) % slots] is not None:
            tried[s] += 1
        out[slot], turn = s, turn + 1
    return out


@pytest.mark.parametrize("count, slots, turns", [(1, 2, None), (3, 13, None), (5, 101, None), (3, 97, [0, 1, 0, 2]), (13, 13, None)])
def test_table_equals_the_plain_loop(spark, count, slots, turns):
    names = [f"s{k}" for k in range(count)]
    rows = sorted(placement.lookup_table(spark, names, slots, turns).collect())
    assert [r["shard"] for r in rows] == filled(names, slots, turns) and [r["slot"] for r in rows] == list(range(slots))
    assert all(r["shard_name"] == names[r["shard"]] for r in rows)


def test_shares_are_even_and_few_slots_move(spark):
    names = [f"s{k}" for k in range(10)]
    shards = lambda n: [r["shard_name"] for r in sorted(placement.lookup_table(spark, n, 1009).collect())]
    before, after = shards(names), shards(names[:-1])
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(a != b for a, b in zip(before, after) if a != "s9") < 0.1 * 1009


def test_edges(spark, edges, empty, edge_rows):
    table = placement.lookup_table(spark, ["a", "b"], 11)
    rows = placement.sharded(edges, table, 11).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, *_ in edge_rows)
    assert len({(r["doc_id"], r["slot"], r["shard"]) for r in rows}) == len({d for d, *_ in edge_rows})
    assert placement.sharded(empty, table, 11).collect() == []


@pytest.mark.parametrize("names, slots", [([], 11), (["a"], 12), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(spark, names, slots):
    with pytest.raises(ValueError):
        placement.lookup_table(spark, names, slots)


def test_no_python_in_the_plan(spark, edges):
    plan = placement.sharded(edges, placement.lookup_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
