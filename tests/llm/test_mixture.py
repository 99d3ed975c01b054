import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidecase.llm import mixture


def water(budget, supply, weight):
    live, given = dict(supply), {}
    while live:
        rate = budget / sum(weight[k] for k in live)
        spent = [k for k, s in live.items() if s < rate * weight[k]]
        if not spent:
            return given | {k: min(s, int(rate * weight[k] + 1e-9)) for k, s in live.items()}
        for k in spent:
            given[k] = live.pop(k)
            budget -= given[k]
    return given


def budgets(budget, supply, weights, path=()):
    """Plain recursion over the tree."""
    if () in supply:
        return {path: budget}
    children = defaultdict(dict)
    for key, s in supply.items():
        children[key[0]][key[1:]] = s
    given = water(budget, {c: sum(x.values()) for c, x in children.items()}, {c: weights.get((*path, c), 1) for c in children})
    return {k: v for c, x in children.items() for k, v in budgets(given[c], x, weights, (*path, c)).items()}


@pytest.mark.parametrize("percent, epochs, weights", [(50, 1, {}), (80, 2, {}), (150, 2, {("domain0",): 5, ("domain0", "l1"): 3}), (500, 2, {}), (0, 1, {})])
def test_budgets_and_prefixes_against_plain_code(make, prose, percent, epochs, weights):
    rng = random.Random(2)
    rows = [(i, prose(rng.randint(1, 30), i), f"l{rng.randrange(3)}", "src0" if i % 3 == 0 else f"src{rng.randrange(12)}") for i in range(150)]
    counted = mixture.token_counts(make(rows))
    got = [r.asDict() for r in mixture.mix(counted, percent, weights, max_epochs=epochs).collect()]
    size = {i: len(re.findall(r"\S+", t)) for i, t, *_ in rows}
    leaf = {i: (f"domain{int(s[3:]) // 5}", g, s) for i, _, g, s in rows}
    leaves = defaultdict(list)
    for i in size:
        leaves[leaf[i]].append(i)
    total = sum(size.values())
    want = budgets(total * percent // 100, {k: epochs * sum(size[i] for i in x) for k, x in leaves.items()}, weights)
    expected = set()
    for key, ids in leaves.items():
        left, epoch = want[key], 0
        while left > 0:
            epoch += 1
            for i in sorted(ids, key=lambda i: hashlib.md5(f"{mixture.SEED}:{epoch}:{i}".encode()).hexdigest()[:12]):
                if left > 0:
                    expected.add((i, epoch, min(left, size[i])))
                    left -= size[i]
    assert {(r["doc_id"], r["epoch"], r["take"]) for r in got} == expected and len(got) == len(expected)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 500), ("a", "y", "1", 500), ("b", "x", "1", 500)], "domain string, lang string, source string, tokens long")
    given = {tuple(r[:3]): r["given"] for r in mixture.leaf_budgets(leaves, 400, max_epochs=1).collect()}
    # Leaf a/x/1 lacks 40 of its 50; its sibling takes them, nothing moves to y or b.
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}


def test_weights_by_level_and_name(spark):
    leaves = spark.createDataFrame([(d, g, "1", 10_000) for d in "ab" for g in "xy"], "domain string, lang string, source string, tokens long")
    given = {tuple(r[:2]): r["given"] for r in mixture.leaf_budgets(leaves, 1200, {"domain": {"b": 2}, "lang": {"x": 3}}).collect()}
    assert given == {("a", "x"): 300, ("a", "y"): 100, ("b", "x"): 600, ("b", "y"): 200}


@pytest.mark.parametrize("sent", [0, 50_000])
def test_rows_are_kept_by_themselves(make, prose, monkeypatch, sent):
    monkeypatch.setattr(mixture, "SENT_LEAVES", sent)
    rows = [(None, prose(10, i)) for i in range(10)] + [(i // 2, prose(10, 50 + i)) for i in range(40)] + [(1, None), (None, " ")]
    kept = mixture.keep_mixed(make(rows), 50).collect()
    texts = [r["text"] for r in kept]
    assert len(kept) == 27 and len({t for t in texts if t and t.strip()}) == 25 and texts.count(None) == 1
    assert 0 < sum(r["doc_id"] is None for r in kept) <= 12
    assert mixture.keep_mixed(make(rows), 100).count() == len(rows) and mixture.keep_mixed(make([]), 50).count() == 0


def test_edges(edges, empty, edge_rows):
    got = mixture.mix(mixture.token_counts(edges), percent=100, max_epochs=1).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in edge_rows]
    assert sum(r["take"] for r in got) == sum(sizes) and len(got) == sum(n > 0 for n in sizes)
    assert mixture.mix(mixture.token_counts(empty)).collect() == []


def test_repeated_rows_in_the_slot_that_is_cut(make):
    rows = [(1, "a b c", "en", "src1")] * 10
    got = mixture.mix(mixture.token_counts(make(rows)), percent=50, max_epochs=1).collect()
    assert sorted(r["take"] for r in got) == [3, 3, 3, 3, 3]
