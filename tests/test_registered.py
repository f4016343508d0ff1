"""Every registered query against its SQL counterpart, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks import catalog, oracle
from checks.compare import compare, connect

QUERIES, SQL = catalog.registered(), oracle.statements()
WITHOUT_SQL = {
    "ml_logreg_metrics", "ml_forest_metrics", "ml_gbt_metrics", "ml_model_selection", "ml_importance",
    "score_strict_three_profiles", "calib_scored", "serve_score", "serve_score_batch", "model_info",
    "ml_class_reports", "calib_zones_out_of_fold",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_only_trained_models_lack_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, sf_dir, con, name):
    assert compare(spark, sf_dir, QUERIES[name], SQL[name], con) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert [r.categorie_cobac for r in entry.entry(spark).collect()] == [
        "1. Saine", "2. Observation", "3. Douteuse", "4. Litigieuse"]
