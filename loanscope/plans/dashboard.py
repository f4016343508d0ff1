"""Aggregates of the dashboard, parameterised by its three filters. ``ALL`` means no filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import decimal_text, pct, rank_in, thousands
from loanscope.functions.rules import classify_masks
from loanscope.operators import segments as S
from loanscope.plans.eda import incident_label
from loanscope.schemas import CLASS_ORDER, INCOME_BANDS, LGD, TARGET

ALL = "ALL"


@dataclass(frozen=True)
class Filters:
    secteur: str = ALL
    produit: str = ALL
    defaut: int | str = ALL

    def condition(self) -> Column:
        """Conjunction of the filters that are set."""
        out = F.lit(True)
        for column, wanted in (
            ("secteur_activite", self.secteur), ("type_produit", self.produit), (TARGET, self.defaut),
        ):
            if wanted != ALL:
                out = out & (F.col(column) == F.lit(wanted))
        return out


def filtered(credits: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return credits.filter(filters.condition())


def filter_values(credits: DataFrame) -> DataFrame:
    """Distinct sorted values offered by the sector and product filters, one pass for both."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("filtre"), F.col(c).alias("valeur"))
        for name, c in (("secteur", "secteur_activite"), ("produit", "type_produit"))])
    return credits.select(F.inline(pairs)).filter(F.col("valeur").isNotNull()).distinct().orderBy("filtre", "valeur")


def kpis(credits: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Indicators of the selection and its share of the whole portfolio, in one pass over the unfiltered table."""
    hit = F.coalesce(filters.condition(), F.lit(False))
    amount = F.col(S.AMOUNT).cast("bigint")
    none = F.lit(0).cast("bigint")
    return credits.agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(hit).alias("nb_prets"),
        F.sum(F.when(hit, F.col(TARGET)).cast("bigint")).alias("nb_defauts"),
        F.count(F.when(hit, F.col(TARGET))).alias("_known"),
        F.sum(F.when(hit, amount).otherwise(none)).alias("encours_fcfa"),
        F.sum(F.when(hit & (F.col(TARGET) == 1), amount).otherwise(none)).alias("_defaulted"),
    ).select(
        "nb_prets",
        F.bround(pct(F.col("nb_prets"), F.col("_all")), 1).alias("part_portefeuille_pct"),
        F.bround(pct(F.col("nb_defauts"), F.col("_known")), 2).alias("taux_defaut_pct"),
        F.coalesce("nb_defauts", none).alias("nb_defauts"),
        "encours_fcfa",
        (F.col("_defaulted").cast("double") * F.lit(LGD)).alias("perte_potentielle_fcfa"),
    )


def rate_by(credits: DataFrame, key: str, filters: Filters = Filters()) -> DataFrame:
    """Default rate per category of the selection, ascending."""
    return S.totals(S.without_missing(filtered(credits, filters), key), key).select(
        key, F.col("n_cible").alias("nb_prets"), S.mean_default().alias("mean"), S.rate_mean().alias("taux"),
    ).orderBy(F.asc_nulls_last("taux"), key)


def by_incident(credits: DataFrame, filters: Filters = Filters()) -> DataFrame:
    labelled = filtered(credits, filters).withColumn("incidents", incident_label("Sans incidents", "Avec incidents"))
    return S.totals(S.without_missing(labelled, "incidents"), "incidents").select(
        "incidents", F.col("n_cible").alias("nb_prets"), S.rate_mean().alias("taux")).orderBy("incidents")


def by_income(credits: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return rate_by(credits, "tranche_revenu", filters).select("tranche_revenu", "nb_prets", "taux").orderBy(
        rank_in("tranche_revenu", INCOME_BANDS.labels).asc_nulls_last())


def class_matrix(credits: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Mask-rule classes of the selection; only those present."""
    classed = filtered(credits, filters).withColumn("categorie_cobac", classify_masks())
    return S.totals(classed, "categorie_cobac").select(
        "categorie_cobac", F.col("n_cible").alias("nb"), S.rate_mean().alias("taux"),
    ).orderBy(rank_in("categorie_cobac", CLASS_ORDER))


def top_segments(credits: DataFrame, filters: Filters = Filters(), min_n: int = 20, top: int = 10) -> DataFrame:
    """Riskiest sector x product pairs of the selection by default rate, with display texts."""
    keys = ("secteur_activite", "type_produit")
    ranked = (
        S.totals(S.without_missing(filtered(credits, filters), *keys), *keys)
        .filter(F.col("n_cible") >= min_n)
        .withColumn("mean", S.mean_default())
        .orderBy(F.desc_nulls_last("mean"), *keys)
        .limit(top)
    )
    return ranked.select(
        F.col("secteur_activite").alias("secteur"), F.col("type_produit").alias("produit"),
        thousands("n_cible").alias("nb_prets"),
        F.concat(decimal_text(S.rate_mean(), 2), F.lit(" %")).alias("taux_defaut"))


def dashboard(credits: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """Everything one change of the filters refreshes."""
    return {
        "kpis": kpis(credits, filters),
        "secteur": rate_by(credits, "secteur_activite", filters),
        "produit": rate_by(credits, "type_produit", filters),
        "incidents": by_incident(credits, filters),
        "revenu": by_income(credits, filters),
        "classes": class_matrix(credits, filters),
        "segments": top_segments(credits, filters),
    }
