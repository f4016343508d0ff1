"""Exploratory tables: the data behind each chart of the exploratory report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import half_even
from loanscope.operators import segments as S
from loanscope.operators.order_stats import quantile
from loanscope.schemas import AGE_BANDS, INCOME_BANDS


def global_analysis(credits: DataFrame) -> DataFrame:
    """Headline indicators, including the exact median income."""
    median = quantile(credits, "revenu_mensuel_fcfa", 0.5)
    return S.totals(credits).select(
        F.col("n").alias("total_prets"),
        S.rate_mean().alias("taux_defaut_global"),
        F.col("encours").alias("montant_total_fcfa"),
        S.mean_of(S.AMOUNT).alias("montant_moyen_fcfa"),
        F.col("encours_defaut").alias("encours_defaut_fcfa"),
        half_even(S.mean_of("taux_interet"), 2).alias("taux_interet_moyen"),
        F.lit(median).cast("double").alias("revenu_median"),
        half_even(S.mean_of("taux_effort"), 2).alias("ratio_effort_moyen"),
    )


def incident_label(without: str, with_: str) -> Column:
    """Only 0 and 1 have a label; any other count is left out."""
    n = F.col("nb_incidents_24m")
    return F.when(n == 0, without).when(n == 1, with_)


def by_incident(credits: DataFrame) -> DataFrame:
    labelled = credits.withColumn("incidents_label", incident_label("Sans incidents (24m)", "Avec incidents (24m)"))
    return S.segment_default_rate(labelled, "incidents_label")


def amount_histogram(credits: DataFrame) -> DataFrame:
    return S.histogram(credits, S.AMOUNT, below_quantile=0.95)


def run_eda(credits: DataFrame) -> dict[str, DataFrame]:
    """The ten tables, in report order."""
    return {
        "defaut_par_age": S.segment_default_rate(credits, "tranche_age", AGE_BANDS.labels),
        "defaut_par_secteur": S.segment_default_rate(credits, "secteur_activite"),
        "defaut_par_produit": S.segment_default_rate(credits, "type_produit"),
        "defaut_par_revenu": S.segment_default_rate(credits, "tranche_revenu", INCOME_BANDS.labels),
        "defaut_par_ville": S.segment_default_rate(credits, "ville"),
        "defaut_par_incidents": by_incident(credits),
        "defaut_par_garantie": S.segment_default_rate(credits, "garantie"),
        "correlations": S.correlation(credits),
        "heatmap_secteur_garantie": S.crosstab(credits, "secteur_activite", "garantie"),
        "distribution_montants": amount_histogram(credits),
    }


def save_eda(credits: DataFrame, output_dir: str) -> dict[str, DataFrame]:
    tables = run_eda(credits)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{output_dir}/{name}")
    return tables
