"""The registered queries: SQL where there is any, and the pipeline against its own stages done directly."""

import pytest

import corpus_pipeline
from barloom.llm.common import table
from barloom.llm.queries import QUERIES, SQL
from checks.compare import compare, connection


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, sf_dir, name):
    ok, note = compare(spark, connection(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    mixed = corpus_pipeline.mix(spark, kept, sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= left
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    want = sorted(r.doc_id for r in mixed.select("doc_id").collect())
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == want
