"""The pipeline on the smallest tables: every stage on what the one before it kept."""

import re

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from loanscope.llm import decontaminate, pipeline, queries, simhash
from loanscope.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = pipeline.staged(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if n < 4:
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in simhash.near_duplicates(before, radius=pipeline.NEAR_BITS).collect()}
        if name == "benchmark_decontamination":
            assert decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).count() == 0
    assert counts[0] > counts[1] > 0 and counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_queries_run(spark, sf_dir, name):
    assert queries.registered()[name](spark, sf_dir).count() > 0


def test_native_plans(spark, sf_dir):
    for name in ("op3_decontamination", "op6_url_filters"):
        plan = queries.registered()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_result_as_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.registered()[name], queries.oracle_sql()[name], connect(sf_dir)) == []
