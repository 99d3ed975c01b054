import zlib
from hashlib import sha256

import pytest

from tidecase.llm import merkle


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climbed(nodes, at, changed):
    """(root, siblings, root with the changed node) of a list of nodes, level by level."""
    siblings = ""
    while len(nodes) > 1:
        first = at // 8 * 8
        run = nodes[first : first + 8]
        siblings += "".join(run[: at - first] + run[at - first + 1 :])
        changed = digest(run[: at - first] + [changed] + run[at - first + 1 :])
        nodes, at = [digest(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], siblings, changed


def expected(rows):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        here, other = leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, low))
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, here, other if tampered else here, tampered))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort()
    subroots = [climbed([x[2] for x in langs[lang]], 0, "")[0] for lang in order]
    out = []
    for at, lang in enumerate(order):
        for i, (known, doc_id, here, other, tampered) in enumerate(langs[lang]):
            sub, low, changed = climbed([x[2] for x in langs[lang]], i, other)
            root, high, folded = climbed(subroots, at, changed)
            out.append((doc_id if known else None, here, sub, root, digest([low, high]), folded, folded == root, tampered))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "tampered").collect()), key=str)


def whole(rows):
    return [(r[0], r[1], *((list(r[2:]) + ["en", "src1"])[:2] if len(r) < 4 else r[2:4]), None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_like_the_definition(make, prose, levels):
    langs = [None, "", "en", "é", "z", *(f"l{i}" for i in range(12))]
    rows = [(i * 5 - 40, prose(1 + i % 7, i).title(), "en" if i % 3 else langs[i % len(langs)], None if i % 11 == 0 else "s") for i in range(400)]
    rows += [(3, "Twice", "en", "s")] * 3 + [(3, "Other", "en", "s"), (None, "A", "en", "s"), (None, None, None, None), (77, "ÀB ", "alone", "s")]
    assert got(merkle.manifest(make(rows), levels)) == expected(whole(rows))


def test_edges(edges, empty, edge_rows, make):
    assert got(merkle.manifest(edges)) == expected(whole(edge_rows))
    assert merkle.manifest(empty).collect() == []
    one = [(6, "UP", "en", "s")]
    assert got(merkle.manifest(make(one))) == expected(whole(one))


def test_midstates_skip_what_is_on_the_left():
    children = [digest([str(i)]).encode() for i in range(8)]
    root, before = merkle._parent(children)
    assert merkle._resumed(before[5], children[5], children[6:]) == root and len(before) == 8
