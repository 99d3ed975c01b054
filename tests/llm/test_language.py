import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidecase.llm import language

SYLLABLES = {"aa": "ta ri mo ke", "bb": "zup gorn wex fli", "cc": "éa oû çi na"}


def corpus(prose):
    return [(i, prose(20 + i % 30, i, SYLLABLES[lang]), lang) for i in range(240) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_held_out_documents(make, prose):
    rows = corpus(prose)
    out = {r["doc_id"]: r for r in language.identify(make([(i, t, g, "s") for i, t, g in rows])).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i]["held_out"] == (i in held) for i in out)
    assert sum(out[i]["lang_pred"] == rows[i][2] for i in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_prediction_sees_the_text_alone(make, prose):
    rows = corpus(prose)
    model = language.fit(make([(i, t, g, "s") for i, t, g in rows]), F.lit(True))
    mixed = [(9000 + i, t, None, None) for i, t, _ in rows[:30]]
    assert [r["lang_pred"] for r in sorted(language.predict(make(mixed), model).collect())] == [g for _, _, g in rows[:30]]


def test_unseen_words_fall_back_to_shorter_grams():
    model = language.Model(["aa", "bb"], {"tari": [5, 0], "gorn": [0, 5]}, {"^zu": [0, 3], "k": [9, 1], "x": [1, 9]})
    assert model.score("tari")[0] == "aa" and model.score("gorn gorn tari")[0] == "bb"
    assert model.score("zuzu")[0] == "bb"  # by ^zu
    assert model.score("kkk")[0] == "aa" and model.score("kxx")[0] == "bb"  # by single letters
    assert model.score("漢字") == ("aa", 0.5)  # nothing known: even, the first is named
    assert model.score("12 !?")[0] == model.score("")[0] == "und"


def test_edges(make, edges, empty, edge_rows):
    rows = language.identify(edges).collect()
    assert len(rows) == len(edge_rows)
    model = language.Model(["en"], {"one": [3]}, {})
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(edges, model).collect()}
    assert {(7, "und"), (3, "und"), (5, "und"), (21, "und"), (11, "en"), (8, "en")} <= got
    assert language.identify(empty).collect() == []
    assert {r["lang_pred"] for r in language.identify(make([(1, "some words", None, None), (2, None, None, None)])).collect()} == {"und"}
    kept = language.keep_identified(edges, model)
    assert kept.columns == edges.columns and {r["doc_id"] for r in kept.collect()} == {11, 2, None, 8, 9, 20, 12}


def brute(rows, text):
    """(language, score) by counting words and n-grams in plain code; ``rows``: (text, lang)."""
    langs = sorted({g for _, g in rows})
    words, grams = {}, {}
    for t, g in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words.setdefault(w, Counter())[g] += 1
            for n in range(1, 5):
                s = f"^{w}$" if n > 1 else w
                for i in range(max(len(s) - n, 0) + 1):
                    grams.setdefault(s[i : i + n], Counter())[g] += 1
    tables = [{k: c for k, c in x.items() if sum(c.values()) > 1} for x in (words, grams)]
    log = [
        {k: [math.log((c[g] + 0.5) / (sum(d[g] for d in x.values()) + 0.5 * len(x) + 1)) for g in langs] for k, c in x.items()} for x in tables
    ]
    total = [0.0] * len(langs)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        found = [log[0][w]] if w in log[0] else []
        for n in range(4, 0, -1):
            s = f"^{w}$" if n > 1 else w
            found = found or [log[1][s[i : i + n]] for i in range(len(s) - n + 1) if s[i : i + n] in log[1]]
        if found:
            total = [a + sum(x) / len(found) for a, x in zip(total, zip(*found))]
    odds = [math.exp(x - max(total)) for x in total]
    return langs[odds.index(1.0)], 1 / sum(odds)


@pytest.mark.parametrize("cells", [0, language.TABLE_CELLS])
def test_like_plain_counting(make, prose, monkeypatch, cells):
    monkeypatch.setattr(language, "TABLE_CELLS", cells)
    rows = corpus(prose)[:60]
    model = language.fit(make([(i, t, g, "s") for i, t, g in rows]), F.lit(True))
    others = [prose(12, 1000 + i, "ta zup éa ri gorn oû qw x") for i in range(40)] + ["tari", "xq", "gornwexfli flimo"]
    for text in others:
        name, score = model.score(text)
        want, odds = brute([(t, g) for _, t, g in rows], text)
        assert name == want and abs(score - odds) < 1e-9


def test_many_languages_keep_their_words(make):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3 + "common shared words", f"l{i:03d}", "s") for i in range(260)]
    model = language.fit(make(rows), F.lit(True))
    assert len(model.languages) == 260 and all(model.score(t)[0] == g for _, t, g, _ in rows)


def test_without_any_language_all_rows_stay(make):
    docs = make([(i, "some words", None, None) for i in range(6)] + [(7, None, None, None)])
    assert language.keep_identified(docs, language.fit(docs, F.lit(True))).count() == 7
