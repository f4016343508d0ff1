"""The ten portfolio reports, their export, and the table catalogue they are queried from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.functions.expressions import decimal_text, half_away, pct, rank_in
from loanscope.functions.rules import classify_sql
from loanscope.operators import segments as S
from loanscope.operators.segments import AMOUNT, mean_of, rate_sql, scaled, share_of_total
from loanscope.schemas import INCOME_BANDS, LGD
from loanscope.session import staged


@dataclass(frozen=True)
class Report:
    """Segment keys (some computed from the loan) and a projection over the totals of each segment."""

    keys: tuple[str, ...]
    finish: Callable[[DataFrame], DataFrame]
    computed: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def run(self, credits: DataFrame) -> DataFrame:
        return self.finish(S.totals(_with(credits, self.computed), *self.keys))


def _with(credits: DataFrame, computed: dict[str, Callable[[], Column]]) -> DataFrame:
    return credits.withColumns({name: make() for name, make in computed.items()}) if computed else credits


def _mean(c: str, digits: int) -> Column:
    return half_away(mean_of(c), digits)


def _kpi(t: DataFrame) -> DataFrame:
    return t.select(
        F.col("n").alias("total_prets"),
        "nb_defauts",
        rate_sql().alias("taux_defaut_pct"),
        scaled("encours", 1e9, 3).alias("encours_milliards_fcfa"),
        scaled("encours_defaut", 1e9, 3).alias("encours_defaut_milliards_fcfa"),
        _mean(AMOUNT, 0).alias("montant_moyen_fcfa"),
        _mean("taux_interet", 2).alias("taux_interet_moyen"),
        _mean("taux_effort", 2).alias("taux_effort_moyen"),
    )


def _by_sector(min_n: int) -> Callable[[DataFrame], DataFrame]:
    def finish(t: DataFrame) -> DataFrame:
        return t.filter(F.col("n") >= min_n).select(
            "secteur_activite",
            F.col("n").alias("nb_prets"),
            "nb_defauts",
            rate_sql().alias("taux_defaut_pct"),
            _mean(AMOUNT, 0).alias("montant_moyen"),
            scaled("encours", 1e6, 1).alias("exposition_millions_fcfa"),
            scaled("encours_defaut", 1e6, 1).alias("perte_potentielle_millions"),
        ).orderBy(F.desc_nulls_last("taux_defaut_pct"), "secteur_activite")
    return finish


def _by_product(t: DataFrame) -> DataFrame:
    return t.select(
        "type_produit",
        F.col("n").alias("nb_prets"),
        rate_sql().alias("taux_defaut_pct"),
        _mean(AMOUNT, 0).alias("montant_moyen"),
        _mean("duree_mois", 0).alias("duree_moyenne_mois"),
        _mean("taux_interet", 2).alias("taux_moyen"),
    ).orderBy(F.desc_nulls_last("taux_defaut_pct"), "type_produit")


def _by_income(t: DataFrame) -> DataFrame:
    return t.select(
        "tranche_revenu",
        F.col("n").alias("nb_prets"),
        rate_sql().alias("taux_defaut_pct"),
        _mean("revenu_mensuel_fcfa", 0).alias("revenu_moyen"),
        _mean(AMOUNT, 0).alias("montant_moyen"),
        scaled("encours_defaut", 1e6, 1).alias("perte_potentielle_millions"),
    ).orderBy(rank_in("tranche_revenu", INCOME_BANDS.labels).asc_nulls_first())


def incident_category() -> Column:
    """No incident against any other value (an unknown count is not "none")."""
    return F.when(F.col("nb_incidents_24m") == 0, "Sans incidents (24m)").otherwise("Avec incidents (24m)")


def _incidents(t: DataFrame) -> DataFrame:
    return t.select(
        "categorie",
        F.col("n").alias("nb_prets"),
        "nb_defauts",
        rate_sql().alias("taux_defaut_pct"),
        _mean(AMOUNT, 0).alias("montant_moyen"),
    ).orderBy(F.desc_nulls_last("taux_defaut_pct"), "categorie")


def _geography(t: DataFrame) -> DataFrame:
    return t.select(
        "ville",
        F.col("n").alias("nb_clients"),
        scaled("encours", 1e6, 1).alias("encours_millions"),
        half_away(share_of_total("encours"), 2).alias("concentration_pct"),
        rate_sql().alias("taux_defaut_pct"),
    ).orderBy(F.desc_nulls_last("encours_millions"), "ville")


def _critical(min_n: int, top: int) -> Callable[[DataFrame], DataFrame]:
    def finish(t: DataFrame) -> DataFrame:
        return t.filter(F.col("n") >= min_n).select(
            "secteur_activite", "garantie",
            F.col("n").alias("nb_prets"),
            rate_sql().alias("taux_defaut_pct"),
            scaled("encours", 1e6, 1).alias("exposition_millions"),
        ).orderBy(F.desc_nulls_last("taux_defaut_pct"), F.asc_nulls_last("secteur_activite"),
                  F.asc_nulls_last("garantie")).limit(top)
    return finish


def _class_matrix(t: DataFrame) -> DataFrame:
    return t.select(
        "categorie_cobac",
        F.col("n").alias("nb_credits"),
        scaled("encours", 1e9, 3).alias("encours_milliards"),
        half_away(share_of_total("n"), 2).alias("part_pct"),
        rate_sql().alias("taux_defaut_observe"),
    ).orderBy("categorie_cobac")


def _top_segments(min_n: int, top: int) -> Callable[[DataFrame], DataFrame]:
    def finish(t: DataFrame) -> DataFrame:
        return t.filter(F.col("n") >= min_n).select(
            "secteur_activite", "type_produit",
            F.col("n").alias("nb_prets"),
            rate_sql().alias("taux_defaut_pct"),
            scaled("encours_defaut", 1e6, 1).alias("perte_potentielle_millions"),
        ).orderBy(F.desc_nulls_last("perte_potentielle_millions"), F.asc_nulls_last("secteur_activite"),
                  F.asc_nulls_last("type_produit")).limit(top)
    return finish


def critical_segments(min_n: int = 50, top: int = 15) -> Report:
    return Report(("secteur_activite", "garantie"), _critical(min_n, top))


REPORTS: dict[str, Report] = {
    "kpi_globaux": Report((), _kpi),
    "defaut_par_secteur": Report(("secteur_activite",), _by_sector(30)),
    "defaut_par_produit": Report(("type_produit",), _by_product),
    "defaut_par_revenu": Report(("tranche_revenu",), _by_income),
    "impact_incidents": Report(("categorie",), _incidents, {"categorie": incident_category}),
    "analyse_geographique": Report(("ville",), _geography),
    "segments_critiques": critical_segments(),
    "matrice_cobac": Report(("categorie_cobac",), _class_matrix, {"categorie_cobac": classify_sql}),
    "top_segments_risque": Report(("secteur_activite", "type_produit"), _top_segments(30, 10)),
}
SUMMARY = "dashboard_synthetique"


def report(credits: DataFrame, name: str) -> DataFrame:
    return summary(credits) if name == SUMMARY else REPORTS[name].run(credits)


_SUMMARY_SETS = ((), ("secteur_activite",), ("type_produit",))


def _summary_rows(t: DataFrame) -> DataFrame:
    """Seven labelled indicators from the overall, per-sector and per-product totals, gathered into one row first."""
    whole = F.col("ensemble") == 0
    one = lambda c: F.max(F.when(whole, c))  # noqa: E731  one row has ensemble 0
    rate1 = half_away(pct(F.col("nb_defauts"), F.col("n")), 1)

    def riskiest(number: int, key: str) -> Column:
        return F.min(F.when(F.col("ensemble") == number, F.struct((-rate1).alias("r"), F.col(key).alias("k"))))

    facts = t.agg(
        one(rate_sql()).alias("rate"),
        one(scaled("encours", 1e9, 2)).alias("exposure"),
        one(scaled("encours_defaut", 1e9, 2)).alias("defaulted"),
        one(half_away(F.col("encours_defaut").cast("double") * LGD / 1e9, 2)).alias("loss"),
        one(half_away(pct(F.col("nb_incidents"), F.col("n")), 2)).alias("incidents"),
        riskiest(1, "secteur_activite").alias("sector"),
        riskiest(2, "type_produit").alias("product"),
    )

    def worst(c: str) -> Column:
        return F.concat(F.col(f"{c}.k"), F.lit(" ("), decimal_text(-F.col(f"{c}.r"), 1), F.lit(" %)"))

    # ---- fixed values: labels of the rows
    rows = [
        ("Taux de défaut global", F.concat(decimal_text("rate", 2), F.lit(" %"))),
        ("Encours total", F.concat(decimal_text("exposure", 2), F.lit(" milliards FCFA"))),
        ("Encours en défaut", F.concat(decimal_text("defaulted", 2), F.lit(" milliards FCFA"))),
        ("Perte potentielle estimée (LGD 60%)", F.concat(decimal_text("loss", 2), F.lit(" milliards FCFA"))),
        ("Clients avec incidents (24m)", F.concat(decimal_text("incidents", 2), F.lit(" %"))),
        ("Secteur le plus risqué", worst("sector")),
        ("Produit le plus risqué", worst("product")),
    ]
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("indicateur"), value.alias("valeur")) for label, value in rows])))


def summary(credits: DataFrame) -> DataFrame:
    """The seven indicators in a single pass over the loans, which fills one row per sector and product."""
    fine = S.totals(credits, "secteur_activite", "type_produit")
    return _summary_rows(S.regrouped_totals(fine, _SUMMARY_SETS))


# Fine segmentations of few segments each, from which every report follows.
_FINE_SETS = (
    ("secteur_activite", "type_produit", "garantie"),
    ("tranche_revenu", "categorie", "categorie_cobac"),
    ("ville",),
)


def all_reports(credits: DataFrame) -> dict[str, DataFrame]:
    """All ten reports from one pass: the loans are aggregated once over three fine segmentations, the totals (one row
    per segment) are written, and each report sums up and projects rows of that small table."""
    computed = {k: v for r in REPORTS.values() for k, v in r.computed.items()}
    cube = staged(S.grouped_totals(_with(credits, computed), _FINE_SETS), "report_totals")

    def part(keys) -> DataFrame:
        number = next(i for i, fine in enumerate(_FINE_SETS) if set(keys) <= set(fine))
        return cube.filter(F.col("ensemble") == number)

    out = {name: r.finish(S.retotalled(part(r.keys), *r.keys)) for name, r in REPORTS.items()}
    out[SUMMARY] = _summary_rows(S.regrouped_totals(part(_SUMMARY_SETS[1] + _SUMMARY_SETS[2]), _SUMMARY_SETS))
    return out


def export_reports(credits: DataFrame, output_dir: str) -> dict[str, DataFrame]:
    """Write one CSV folder per report and return the report frames."""
    reports = all_reports(credits)
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{output_dir}/{name}")
    return reports


class LoanTables:
    """Named tables of a session: publish, query, list."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def publish(self, df: DataFrame, name: str = "credits", persistent: bool = False) -> int:
        """Replace a table and return the number of rows it then holds."""
        if persistent:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)
        return self.spark.table(name).count()

    def query(self, sql: str, **parameters) -> DataFrame:
        """Ad-hoc SQL; parameters are bound as :name, never formatted into the text."""
        return self.spark.sql(sql, args=parameters or None)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def report(self, name: str, table: str = "credits") -> DataFrame:
        return report(self.spark.table(table), name)
