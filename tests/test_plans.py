"""Properties of the physical plans that matter on large tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loanscope.operators import clean as C
from loanscope.operators import segments as S
from loanscope.plans import sql_reports as Q
from loanscope.session import staged


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored_raw(raw):
    return staged(raw, "plan_test")


def operators(text: str) -> list[str]:
    """Operator names of the tree, from the result down to the scan."""
    tree = text.split("\n\n")[0]
    return re.findall(r"(?:^|[*-] )([A-Z]\w+)[ \w]*\(\d+\)", tree, flags=re.M)


def scans(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M))


def test_cleaning_filters_reach_the_scan(stored_raw):
    text = plan(C.deduplicated_first(C.filtered(stored_raw, C.Thresholds(1e6, 1e7))))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", text).group(1)
    for column in ("age", "revenu_mensuel_fcfa", "montant_credit_fcfa", "ratio_endettement"):
        assert re.search(rf"GreaterThanOrEqual\({column},", pushed), column
        assert re.search(rf"LessThanOrEqual\({column},", pushed), column
    assert scans(text) == 1
    assert operators(text).count("Exchange") == 1  # the deduplication


def test_a_report_reads_only_its_columns(credits):
    text = plan(Q.report(credits, "defaut_par_secteur"))
    schema = re.search(r"ReadSchema: struct<(.*?)>\n", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"secteur_activite", "montant_credit_fcfa", "defaut"}


@pytest.mark.parametrize("build", [
    Q.summary,
    lambda c: Q.report(c, "analyse_geographique"),
    lambda c: Q.report(c, "matrice_cobac"),
    S.correlation,
])
def test_one_pass_over_the_loans(credits, build):
    assert scans(plan(build(credits))) == 1


def test_exchanges_of_a_report_carry_partial_sums(credits):
    found = operators(plan(Q.report(credits, "top_segments_risque")))
    assert found[:2] == ["AdaptiveSparkPlan", "TakeOrderedAndProject"]  # no full sort for a top ten
    assert found.count("Exchange") == 1
    i = found.index("Exchange")
    assert found[i - 1] == found[i + 1] == "HashAggregate"


HEAVY = {"ml_logreg_metrics", "ml_forest_metrics", "ml_gbt_metrics", "ml_model_selection", "ml_importance"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - HEAVY))
def test_no_python_rows_and_no_product(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert bad not in text
    # a nested-loop join is only ever against one row of aggregates
    assert text.count("BroadcastNestedLoopJoin Cross") <= 2


def test_hot_copies_collapse_before_the_exchange(spark):
    """A third of the rows are one row: what is exchanged does not grow with it."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("k"), F.lit("x").alias("v"))
    found = operators(plan(C.deduplicated(df)))
    i = found.index("Exchange")
    assert found[i - 1] == found[i + 1] == "HashAggregate"
    assert C.deduplicated(df).count() == 1000
