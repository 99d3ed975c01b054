import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Names that operators use for columns of their own.
CLASHING = ("uid", "piece", "length", "slot", "shard", "block", "component", "tokens", "row", "key", "node", "score", "n", "sketch", "host", "path", "_block", "_key", "word", "h")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def frame(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]) with the clashing columns filled."""
    full = []
    for doc_id, text, *more in rows:
        lang, source = (*more, "en", "src1")[:2] if len(more) < 2 else more
        full.append((doc_id, text, lang, source, None if text is None else len(text), *(["?"] * len(CLASHING))))
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (7, None), (3, ""), (5, " \n\t "), (11, "one"), (11, "one"), (2, "two words"), (None, "no id here"), (None, None, None, None),
    (8, "Ünïcode – ₤ 漢字  x\x00y"), (9, "a  b\n\nc\r\n d "), (20, "lorem ipsum dolor sit amet " * 3000), (21, "!!! ### 123 ;;"), (12, "one", None, None),
]


@pytest.fixture
def edge_rows():
    return EDGES


@pytest.fixture
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture
def prose():
    """``prose(n, seed)``: a text of n made-up words."""

    def build(n, seed, syllables="ta ri mo ke lu sa"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(syllables.split(), k=rng.randint(1, 4))) for _ in range(n))

    return build
