"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from evgraph.llm.common import cut, table
from evgraph.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        kept = cut(stage(spark, docs, SMALL), "test-stage")
        n = kept.count()
        assert 0 < n <= seen, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns, name
        docs, seen = kept, n
    assert docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == seen


def test_stages_on_nothing(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), "test-stage")
    assert docs.count() == 0


def test_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_odd_rows(spark, clashing):
    """Null and repeated ids, empty, very long and repeated texts, and further columns with names that the stages use."""
    docs, columns = clashing, clashing.columns
    given = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SMALL), "test-odd")
        assert docs.columns == columns, name
        kept = docs.collect()
        if name in ("quality_classifier", "ngram_join"):
            assert {(r["doc_id"], r["text"]) for r in kept} <= given, name
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert found.count() == docs.count() and found.where("NOT round_trip").count() == 0
