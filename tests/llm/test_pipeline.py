"""The pipeline and the registered queries, against brute force and SQL."""

from pathlib import Path

import pytest
from comparison import connect, difference
from odd_tables import EXTRA
from test_decontamination import brute_force as contaminated
from test_jaccard_join import brute_force as near_copies

import corpus_pipeline
from slopefield.llm import queries
from slopefield.session import session_settings

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), con, queries.SQL[name]) is None


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert [s for s, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "jaccard_join", "decontaminate", "sentencepiece"
    ]


def test_stages_against_brute_force(spark):
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF_DIR, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        out = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in before)
            assert all(r.restored for r in out.collect())
            continue
        assert out.columns == docs.columns
        docs, kept = out, [(r.doc_id, r.text) for r in out.collect()]
        ids = {i for i, _ in kept}
        if name == "exact_dedup":
            last = {t: i for i, t in sorted(before)}
            assert ids == set(last.values())
        elif name == "jaccard_join":
            assert ids == {c for _, _, c in near_copies(before, 5, 80)}
        elif name == "decontaminate":
            assert ids == {r[0] for r in contaminated(before, items) if not r[5]}
    assert 0 < len(kept) < corpus_pipeline.table(spark, SF_DIR, "documents").count()


def test_odd_rows_go_through(spark, odd, odd_rows):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
    assert 0 < docs.count() < len(odd_rows)


def test_other_file_splits_reject_the_same_rows(spark, table_of):
    # Executors that come or go between two scans change the splits of the second.
    texts = [f"text {k} stands alone here with words w{k} x{k} y{k} z{k}" for k in range(60)]
    docs = table_of([(k, texts[k % 50], "en", None, None, *EXTRA) for k in range(60)])
    splits = {"spark__sql__files__openCostInBytes": "64m", "spark__sql__files__maxPartitionBytes": "64m"}
    with session_settings(spark, **splits):
        kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    splits = {"spark__sql__files__openCostInBytes": "1m", "spark__sql__files__maxPartitionBytes": "1g",
              "spark__sql__files__minPartitionNum": "1"}
    with session_settings(spark, **splits):
        rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == list(range(50)) and {r._row for r in rows} == {7}
