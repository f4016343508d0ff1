"""Boundaries of bands, classes, grades, decisions, scores and texts."""

import pytest
from pyspark.sql import functions as F

from loanscope.functions import expressions as X
from loanscope.functions import rules as R
from loanscope.operators import derive as D
from loanscope.schemas import AGE_BANDS, AMOUNT_BANDS, DECISIONS_V1, GRADES_V1, INCOME_BANDS, PRODUCT_RISK, SECTOR_RISK


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_age_bands(spark):
    ages = [17, 18, 30, 31, 45, 60, 61, 100, 101, None]
    assert column(spark, ages, "int", X.banded("x", AGE_BANDS)) == [
        None, "18-29", "18-29", "30-44", "30-44", "45-59", "60+", "60+", None, None]


def test_money_bands(spark):
    assert column(spark, [0, 1, 200_000, 200_001, 500_000, 1_000_000, 1_000_001], "bigint",
                  X.banded("x", INCOME_BANDS)) == [
        None, "<200k", "<200k", "200-500k", "200-500k", "500k-1M", ">1M"]
    assert column(spark, [500_000, 500_001, 2_000_000, 10_000_000, 10_000_001], "bigint",
                  X.banded("x", AMOUNT_BANDS)) == ["<500k", "500k-2M", "500k-2M", "2M-10M", ">10M"]


def test_class_rules_on_the_whole_grid(spark):
    efforts = [29.99, 30.0, 39.99, 40.0, 49.99, 50.0, None]
    grid = [(e, i) for e in efforts for i in (0, 1, 2, None)]
    df = spark.createDataFrame(grid, "taux_effort double, nb_incidents_24m int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in df.select("*", R.classify_sql(), R.classify_masks()).collect()}

    def expect(e, i):
        def true(x):
            return bool(x)  # an unknown comparison is not true
        e_known, i_known = e is not None, i is not None
        none, once = true(i_known and i == 0), true(i_known and i == 1)
        if none and e_known and e < 30:
            s = "1. Saine"
        elif none and e_known and e < 40:
            s = "2. Observation"
        elif once or (e_known and e < 50):
            s = "3. Douteuse"
        else:
            s = "4. Litigieuse"
        m = "Saine"
        if e_known and e >= 30 and none:
            m = "Observation"
        if (e_known and e >= 40) or once:
            m = "Douteuse"
        if e_known and e >= 50 and once:
            m = "Litigieuse"
        return s, m

    assert got == {(e, i): expect(e, i) for e, i in grid}


def test_arrears_and_provision(spark):
    days = [0, 1, 89, 90, 179, 180, 359, 360, None]
    assert column(spark, days, "int", R.class_by_arrears("x")) == [
        "Saine", "Observation", "Observation", "Douteuse", "Douteuse", "Litigieuse", "Litigieuse", "Irrecouvrable",
        None]
    df = spark.createDataFrame([(101, "Douteuse"), (50, "Observation"), (30, "Observation"), (7, "?")], "m int, c string")
    assert [r[0] for r in df.select(R.provision("m", "c")).collect()] == [30, 2, 2, None]


def test_scores_rounded_and_truncated(spark):
    ps = [0.0, 1.0, 0.5, 0.2765, 0.2755, None]
    assert column(spark, ps, "double", R.score_rounded("x")) == [1000, 0, 500, 724, 724, None]
    assert column(spark, ps, "double", R.score_truncated("x")) == [1000, 0, 500, 723, 724, None]


def test_grades_and_decisions(spark):
    scores = [1000, 800, 799, 700, 699, 650, 649, 587, 586, 500, 499, 400, 399, 350, 349, 0]
    letter = lambda xs: "".join(x[0] for x in xs)
    assert letter(column(spark, scores, "int", R.grade("x", GRADES_V1))) == "AABBBBCCCCDDDDEE"
    assert letter(column(spark, scores, "int", R.grade("x"))) == "AABBCCCCDDDDEEEE"
    cuts = [724, 723, 650, 649, 587, 586, 500, 499, None]
    assert column(spark, cuts, "int", R.decision("x")) == [
        "ACCEPTÉ", "À EXAMINER", "À EXAMINER", "À EXAMINER", "À EXAMINER", "REFUSÉ", "REFUSÉ", "REFUSÉ", None]
    assert column(spark, cuts, "int", R.decision("x", DECISIONS_V1)) == [
        "ACCEPTÉ", "ACCEPTÉ", "ACCEPTÉ", "À EXAMINER", "À EXAMINER", "À EXAMINER", "À EXAMINER", "REFUSÉ", None]


def test_lookup_and_identifier(spark):
    assert column(spark, ["Microfinance", "autre", None], "string", X.lookup("x", PRODUCT_RISK)) == [0.35, None, None]
    assert column(spark, [1, 999_999, 1_234_567], "int", D.client_id("x", "CLI")) == [
        "CLI000001", "CLI999999", "CLI1234567"]


def test_clip_keeps_missing(spark):
    assert column(spark, [-1.0, 0.5, 9.0, None], "double", X.clip("x", 0, 3)) == [0.0, 0.5, 3.0, None]


def test_decimal_text(spark):
    assert column(spark, [18.9, 20.0, 0.05, 12_345_678.25, 1e9], "double", X.decimal_text("x", 2)) == [
        "18.9", "20.0", "0.05", "12345678.25", "1000000000.0"]


def test_grant_dates(spark):
    got = column(spark, [0, 1, 8], "int", D.grant_date("x").cast("string"))
    assert got == ["2022-01-01 00:00:00", "2022-01-01 03:00:00", "2022-01-02 00:00:00"]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(100, 0, 10), (100, 10, 0), (100, 10, None)],
                               "montant_credit_fcfa bigint, duree_mois int, revenu_mensuel_fcfa bigint")
    assert [r[0] for r in df.select(R.debt_ratio()).collect()] == [None, None, None]


def test_row_hash_tells_missing_from_text(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "p string, q string")
    assert df.select(X.row_hash(["p", "q"]).alias("h")).distinct().count() == 3


@pytest.mark.parametrize("digits,expected", [(0, 2.0), (1, 2.5)])
def test_half_even(spark, digits, expected):
    assert spark.range(1).select(X.half_even(F.lit(2.5), digits)).first()[0] == expected


def test_every_risk_weight(spark):
    expected_products = {"Crédit consommation": 0.25, "Crédit immobilier": 0.10, "Crédit PME": 0.30, "Découvert": 0.20,
                         "Crédit auto": 0.15, "Crédit scolaire": 0.12, "Microfinance": 0.35}
    expected_sectors = {"Commerce": 0.20, "BTP": 0.28, "Services": 0.15, "Agriculture": 0.30, "Transport": 0.22, "Industrie": 0.14,
                        "Pétrole & Gaz": 0.10, "Fonction publique": 0.05, "Santé": 0.12, "Éducation": 0.08}
    for expected, table, column, operator in (
            (expected_products, PRODUCT_RISK, "type_produit", D.product_risk),
            (expected_sectors, SECTOR_RISK, "secteur_activite", D.sector_risk)):
        assert set(table) == set(expected)
        rows = spark.createDataFrame([(k,) for k in [*expected, "unknown", None]], f"{column} string")
        got = {r[0]: r[1] for r in rows.select(column, operator()).collect()}
        assert got == expected | {"unknown": None, None: None}
