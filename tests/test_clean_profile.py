from pyspark.sql import functions as F

from checks import loans
from loanscope.operators import clean as C
from loanscope.operators import profile as P
from loanscope.schemas import CLEAN_SCHEMA, LEAKAGE_COLUMNS, RAW_SCHEMA


def test_raw_and_clean_schemas(raw, credits):
    assert [(f.name, f.dataType) for f in raw.schema.fields] == [(f.name, f.dataType) for f in RAW_SCHEMA.fields]
    assert credits.columns == [f.name for f in CLEAN_SCHEMA.fields]


def test_known_counts_at_the_smallest_scale(raw, credits):
    assert raw.count() == 6081
    assert credits.count() == 4649


def test_steps_add_up(spark, sf_dir):
    r = loans.cleaned(spark, sf_dir).report().first()
    dropped = sum(r[c] for c in ("filtrage_age", "filtrage_revenus", "filtrage_montants", "filtrage_ratio",
                                 "doublons_supprimes"))
    assert r["n_initial"] - dropped == r["n_final"]
    assert r["lignes_supprimees"] == dropped
    assert r["colonnes_supprimees"] == len(LEAKAGE_COLUMNS)
    assert all(r[c] > 0 for c in r.asDict())


def test_clean_rows_are_distinct_and_in_range(credits):
    assert C.deduplicated(credits).count() == credits.count()
    bad = credits.filter(~(F.col("age").between(18, 80) & (F.col("revenu_mensuel_fcfa") >= 50_000)
                           & (F.col("montant_credit_fcfa") >= 100_000)))
    assert bad.count() == 0
    assert credits.filter("anciennete_client_mois is null").count() == 0
    assert credits.filter("garantie is null").count() > 0  # texts keep their gaps


def test_cleaning_against_pandas(raw, credits):
    """The whole chain once more in pandas, on the same raw rows."""
    pdf = raw.drop(*LEAKAGE_COLUMNS).toPandas()
    pdf = pdf[pdf.age.between(18, 80)]
    pdf = pdf[(pdf.revenu_mensuel_fcfa >= 50_000) & (pdf.revenu_mensuel_fcfa <= pdf.revenu_mensuel_fcfa.quantile(.99))]
    pdf = pdf[(pdf.montant_credit_fcfa >= 100_000)
              & (pdf.montant_credit_fcfa <= pdf.montant_credit_fcfa.quantile(.995))]
    pdf = pdf[pdf.ratio_endettement.between(0, 1.5)].drop_duplicates()
    effort = (pdf.montant_credit_fcfa / pdf.duree_mois / pdf.revenu_mensuel_fcfa * 100).round(2)
    got = credits.agg(F.count("*"), F.sum("montant_credit_fcfa"), F.sum("defaut"), F.sum("taux_effort"),
                      F.sum("anciennete_client_mois")).first()
    tenure = pdf.anciennete_client_mois.fillna(pdf.anciennete_client_mois.median())
    assert got[:3] == (len(pdf), pdf.montant_credit_fcfa.sum(), pdf.defaut.sum())
    assert abs(got[3] - effort.sum()) < 0.02 * len(pdf) ** 0.5
    assert got[4] == tenure.sum()


def test_missing_value_drops_the_row(spark):
    rows = [(a, r, m, q) for a in (30, None) for r in (60_000, None) for m in (200_000, None) for q in (0.5, None)]
    df = spark.createDataFrame(rows, "age int, revenu_mensuel_fcfa bigint, montant_credit_fcfa bigint, "
                                     "ratio_endettement double")
    assert C.filtered(df, C.Thresholds(1e9, 1e9)).count() == 1


def test_thresholds_of_an_empty_table(raw):
    t = C.find_thresholds(raw.filter("age > 200"))
    assert t == C.Thresholds(None, None)
    assert C.filtered(raw, t).count() == 0


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1, 1, None, "a"), (2, 2, None, None), (None, 5, None, "b"), (10, None, None, "c"), (None, 7, None, "d")],
        "odd int, even int, empty int, text string")
    out = C.impute_median(df)
    assert dict(out.dtypes) == {"odd": "int", "even": "double", "empty": "int", "text": "string"}
    assert sorted(r.odd for r in out.collect()) == [1, 2, 2, 2, 10]
    assert sorted(r.even for r in out.collect()) == [1.0, 2.0, 3.5, 5.0, 7.0]
    assert out.filter("empty is null").count() == 5
    assert out.filter("text is null").count() == 1


def test_imputation_takes_not_a_number_for_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (4.0,), (None,)], "x double")
    assert sorted(r.x for r in C.impute_median(df).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_duplicates_and_constants(spark):
    df = spark.createDataFrame([(1, "x", None)] * 3 + [(2, "x", None)], "a int, b string, c string")
    assert P.duplicates(df).first().asDict() == {"doublons": 2, "pourcentage": 50.0}
    assert [r.colonne for r in P.constants(df).collect()] == ["b", "c"]
    assert {r.colonne: r.nb_uniques for r in P.cardinality(df).collect()} == {"b": 1, "c": 0}
    assert [tuple(r) for r in P.missing(df).collect()] == [("c", 4, 100.0)]


def test_profile_of_a_table_without_target(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert P.target_distribution(df) is None
    assert "cible" not in P.full_profile(df)


def test_approximate_cardinality_is_offered(raw):
    exact = {r.colonne: r.nb_uniques for r in P.cardinality(raw).collect()}
    near = {r.colonne: r.nb_uniques for r in P.cardinality(raw, approximate=True).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[c] - n) <= 0.15 * n for c, n in exact.items())
