"""Registered queries against their SQL, and the pipeline's stages."""

import os

import pytest

import corpus_pipeline
from sievework.llm import digests, minhash, queries
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, con, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), con, queries.SQL[name]) in ("same", "close")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_equals_its_stages_by_hand(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = {r.doc_id for r in queries.quality_rules(spark, FOLDER).where("kept").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == judged
    second = corpus_pipeline.exact_dedup(spark, first, FOLDER)
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in digests.exact_groups(first, largest=True).where("kept").collect()}
    third = corpus_pipeline.near_dedup(spark, second, FOLDER)
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in minhash.near_groups(second).where("kept").collect()}
    fourth = corpus_pipeline.mix_sources(spark, third, FOLDER)
    assert fourth.columns == docs.columns
    last = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in fourth.collect())
    assert last.where("n_tokens <> size(ids) OR n_tokens = 0").count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, odd, none, number):
    name, stage = corpus_pipeline.STAGES[number]
    for df in (odd, none):
        out = stage(spark, df, FOLDER)
        assert out.count() <= 2 * df.count()
        if number < 4:
            assert out.columns == df.columns
