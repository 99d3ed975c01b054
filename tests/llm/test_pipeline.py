import re

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tidecase.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_effect(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), name)
        assert docs.columns == COLUMNS
        sizes.append(docs.count())
    toxic, language, near, mixed = (a - b for a, b in zip(sizes, sizes[1:]))
    assert toxic > 0 and language >= 0 and near > 0 and mixed > 0 and sizes[-1] > sizes[0] / 2
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, text in kept.items():
        w = re.findall(r"\S+", text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r["doc_id"] for r in packed} == set(kept)


@pytest.mark.parametrize("name", ["op4_permutation_table", "op8_hierarchical_budget"])
def test_against_sql(spark, data, name):
    from oracle import connect, difference

    assert difference(entry.queries()[name](spark, data), connect(data), entry.oracle_sql()[name]) is None


STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture
def sf_dir(spark, tmp_path):
    """A folder with the given labels only."""

    def build(labels):
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return build


@pytest.mark.parametrize("labels", [[], [(900 + i, i % 2, 0) for i in range(20)], [(2, 0, 1), (11, 0, 0)]])
def test_stages_on_edge_rows(spark, edges, empty, edge_rows, sf_dir, labels):
    folder = sf_dir(labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, edges, folder)
        assert kept.columns == edges.columns, name
        assert stage(spark, empty, folder).count() == 0, name
    assert STAGE["toxicity"](spark, edges, folder).count() == len(edge_rows)  # nothing toxic to learn from
    left = {r["text"] for r in STAGE["near_duplicates"](spark, edges, folder).collect()}
    assert left == {t for _, t, *_ in edge_rows}
    packed = corpus_pipeline.STAGES[-1][1](spark, edges, folder)
    assert packed.count() >= len(edge_rows) and corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0


def test_without_languages_no_document_goes(spark, make, sf_dir):
    docs = make([(i, f"text number {i}", None, None) for i in range(6)])
    assert STAGE["language"](spark, docs, sf_dir([])).count() == 6


def test_a_clean_text_of_a_repeated_id_stays(spark, make, prose, sf_dir):
    text, other = prose(40, 1), prose(40, 2)
    docs = make([(1, text), (2, text + " more"), (2, other), (None, text), (None, prose(40, 3)), (3, ""), (3, None), (4, other), (4, other)])
    kept = STAGE["near_duplicates"](spark, docs, sf_dir([])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, text), (2, other), (None, prose(40, 3)), (3, ""), (3, None)], key=str)


def test_the_mix_takes_rows_without_ids_too(spark, make, prose, sf_dir):
    docs = make([(None if i % 2 else i, prose(10, i), "en", f"src{i % 4}") for i in range(40)])
    kept = STAGE["mixing"](spark, docs, sf_dir([])).collect()
    assert 0.6 * 40 <= len(kept) < 40 and sum(r["doc_id"] is None for r in kept) >= 8 and len({r["text"] for r in kept}) == len(kept)


def test_toxic_words_learnt_from_some_documents(spark, make, prose, sf_dir):
    rows = [(i, prose(30, i) + (" vile grumosk" if i % 4 == 0 else "")) for i in range(200)]
    docs = make([*rows, (500, "a vile grumosk"), (500, "a mild text"), (None, "grumosk vile")])
    kept = STAGE["toxicity"](spark, docs, sf_dir([(i, int(i % 4 == 0), 0) for i in range(200)])).collect()
    assert not any("vile" in r["text"] for r in kept) and sum(r["doc_id"] == 500 for r in kept) == 1 and len(kept) == 151
