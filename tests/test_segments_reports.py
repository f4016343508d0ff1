import pytest
from pyspark.sql import functions as F

from loanscope.operators import segments as S
from loanscope.plans import dashboard as B
from loanscope.plans import eda as E
from loanscope.plans import reporting as R
from loanscope.plans import sql_reports as Q


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def one_pass(credits):
    return Q.all_reports(credits)


@pytest.mark.parametrize("name", [*Q.REPORTS, Q.SUMMARY])
def test_reports_from_one_pass_equal_single_reports(credits, one_pass, name):
    assert rows(one_pass[name]) == rows(Q.report(credits, name))


def test_shares_and_sums(credits):
    n = credits.count()
    matrix = Q.report(credits, "matrice_cobac").toPandas()
    assert matrix.nb_credits.sum() == n
    assert matrix.part_pct.sum() == pytest.approx(100, abs=0.05)
    kpi = Q.report(credits, "kpi_globaux").first()
    assert kpi.total_prets == n
    assert matrix.encours_milliards.sum() == pytest.approx(kpi.encours_milliards_fcfa, abs=0.01)
    geo = Q.report(credits, "analyse_geographique").toPandas()
    assert geo.concentration_pct.sum() == pytest.approx(100, abs=0.2)


def test_threshold_parameter(credits):
    few = Q.critical_segments(min_n=150).run(credits)
    assert all(r.nb_prets >= 150 for r in few.collect())


def test_missing_keys_are_kept_in_reports_and_dropped_in_charts(credits):
    assert credits.filter("garantie is null").count() > 0
    assert Q.Report(("garantie",), lambda t: t.select("garantie")).run(credits).filter("garantie is null").count() == 1
    assert S.segment_default_rate(credits, "garantie").filter("garantie is null").count() == 0


def test_incident_counts_beyond_one(credits):
    """Two incidents are "with" in the report and left out of the chart."""
    beyond = credits.filter("nb_incidents_24m > 1").count()
    assert beyond > 0
    report = {r.categorie: r.nb_prets for r in Q.report(credits, "impact_incidents").collect()}
    chart = {r.incidents_label: r.nb_prets for r in E.by_incident(credits).collect()}
    assert report["Avec incidents (24m)"] == chart["Avec incidents (24m)"] + beyond


def test_export_writes_one_folder_per_report(spark, credits, tmp_path):
    frames = Q.export_reports(credits, str(tmp_path / "sql"))
    assert len(frames) == 10
    for name, df in frames.items():
        back = spark.read.option("header", True).csv(str(tmp_path / "sql" / name))
        assert back.columns == df.columns
        assert back.count() == df.count()


def test_tables_catalogue(spark, credits):
    tables = Q.LoanTables(spark)
    assert tables.publish(credits, "portefeuille_essai") == credits.count()
    assert "portefeuille_essai" in tables.tables()
    got = tables.query("SELECT count(*) AS n FROM portefeuille_essai WHERE age >= :low", low=60).first().n
    assert got == credits.filter("age >= 60").count()
    assert rows(tables.report("kpi_globaux", "portefeuille_essai")) == rows(Q.report(credits, "kpi_globaux"))


def test_ordered_categories(credits):
    got = [r.tranche_age for r in E.run_eda(credits)["defaut_par_age"].collect()]
    assert got == ["18-29", "30-44", "45-59", "60+"]


def test_eda_tables_are_saved(spark, credits, tmp_path):
    tables = E.save_eda(credits, str(tmp_path / "eda"))
    assert len(tables) == 10
    assert spark.read.parquet(str(tmp_path / "eda" / "correlations")).count() == 10


def test_histogram_keeps_the_largest_value(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(101)], "x double, defaut int")
    h = S.histogram(df, "x", bins=50).toPandas()
    assert h.nb.sum() == 101
    assert h.bin.max() == 49
    same = S.histogram(spark.createDataFrame([(5.0, 1)] * 3, "x double, defaut int"), "x")
    assert same.first().nb == 3


def test_histogram_trim_is_strict(credits):
    cut = credits.approxQuantile("montant_credit_fcfa", [0.95], 0.0)[0]
    h = E.amount_histogram(credits)
    assert h.agg(F.sum("nb")).first()[0] == pytest.approx(credits.filter(F.col("montant_credit_fcfa") < cut).count(), abs=1)


def test_crosstab_wide_finds_its_columns(credits):
    wide = S.crosstab_wide(credits, "secteur_activite", "garantie")
    assert wide.columns == ["secteur_activite", "AF", "AO", "NF", "NO", "RF", "RO"]


def test_workbook(spark, credits, tmp_path):
    sheets = R.write_workbook(credits, str(tmp_path / "book"))
    assert set(sheets) == {"synthese", "secteurs", "produits", "classes"}
    assert spark.read.option("header", True).csv(str(tmp_path / "book" / "synthese")).count() == 8


def test_report_texts(credits):
    texts = {r.indicateur: r.valeur for r in R.text_rows(credits).collect()}
    assert texts["Total prêts"] == "4,649"
    assert texts["Taux de défaut global"].endswith(" %")
    assert "Date du rapport" not in texts


def test_dashboard_filters(credits):
    every = B.dashboard(credits)
    assert every["kpis"].first().part_portefeuille_pct == 100.0
    picked = B.Filters(secteur="BUILDING", defaut=1)
    k = B.kpis(credits, picked).first()
    assert k.nb_prets == B.filtered(credits, picked).count() == k.nb_defauts
    assert k.taux_defaut_pct == 100.0


def test_dashboard_without_rows(credits):
    none = B.dashboard(credits, B.Filters(secteur="AUCUN"))
    assert none["kpis"].first().nb_prets == 0
    assert none["kpis"].first().taux_defaut_pct is None
    assert all(df.count() == 0 for name, df in none.items() if name != "kpis")
