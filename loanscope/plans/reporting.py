"""Tables and texts of the regulatory report and its workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import decimal_text, half_even, pct, rank_in, thousands
from loanscope.functions.rules import classify_masks
from loanscope.operators import segments as S
from loanscope.operators.segments import AMOUNT
from loanscope.schemas import CLASS_ORDER


def kpis(credits: DataFrame) -> DataFrame:
    """Nine indicators, one pass."""
    return S.totals(credits).select(
        F.col("n").alias("total_prets"),
        "nb_defauts",
        S.rate_mean().alias("taux_defaut"),
        F.col("encours").alias("encours_total_fcfa"),
        F.col("encours_defaut").alias("encours_defaut_fcfa"),
        S.loss().alias("perte_potentielle_fcfa"),
        S.mean_of(AMOUNT).alias("montant_moyen_fcfa"),
        half_even(S.mean_of("taux_interet"), 2).alias("taux_interet_moyen"),
        half_even(S.mean_of("taux_effort"), 2).alias("taux_effort_moyen"),
    )


def sector_table(credits: DataFrame) -> DataFrame:
    """Sectors by falling default rate, each with its own exposure."""
    return S.totals(S.without_missing(credits, "secteur_activite"), "secteur_activite").orderBy(
        S.mean_default().desc_nulls_last(), "secteur_activite").select(
        "secteur_activite",
        F.col("n_cible").alias("nb_prets"),
        "nb_defauts",
        S.rate_mean().alias("taux"),
        half_even(F.col("encours").cast("double") / 1e6, 1).alias("exposition_millions"),
    )


def sector_extremes(credits: DataFrame) -> DataFrame:
    """Worst and best sector and the sentence that compares them."""
    by_sector = S.totals(S.without_missing(credits, "secteur_activite"), "secteur_activite")
    entry = F.struct((-S.mean_default()).alias("m"), F.col("secteur_activite").alias("k"), S.rate_mean().alias("t"))
    found = by_sector.agg(F.min(entry).alias("worst"), F.max(entry).alias("best"))
    text = F.format_string(
        "%s est le secteur où les défauts sont les plus fréquents : %.2f%% des prêts. %s en compte le moins : %.2f%%.",
        F.col("worst.k"), F.col("worst.t"), F.col("best.k"), F.col("best.t"))
    return found.select(
        F.col("worst.k").alias("secteur_plus_risque"), F.col("worst.t").alias("taux_plus_eleve"),
        F.col("best.k").alias("secteur_moins_risque"), F.col("best.t").alias("taux_plus_faible"),
        text.alias("constat"))


def product_table(credits: DataFrame) -> DataFrame:
    return S.totals(S.without_missing(credits, "type_produit"), "type_produit").orderBy(
        S.mean_default().desc_nulls_last(), "type_produit").select(
        "type_produit",
        F.col("n_cible").alias("nb_prets"),
        "nb_defauts",
        S.rate_mean().alias("taux"),
    )


def _by_mask_class(credits: DataFrame) -> DataFrame:
    return S.totals(credits.withColumn("categorie_cobac", classify_masks()), "categorie_cobac")


def _share_of_rows() -> Column:
    """Loans of the class with a known label, in percent of all loans."""
    return half_even(pct(F.col("n_cible"), F.sum("n").over(Window.partitionBy())), 2)


def class_table(credits: DataFrame) -> DataFrame:
    """Mask-rule classes in regulatory order; classes without loans do not appear."""
    return _by_mask_class(credits).select(
        "categorie_cobac",
        F.col("n_cible").alias("nb_credits"),
        _share_of_rows().alias("part_pct"),
        half_even(F.col("encours").cast("double") / 1e9, 3).alias("encours_mds"),
        S.rate_mean().alias("taux_defaut_pct"),
    ).orderBy(rank_in("categorie_cobac", CLASS_ORDER))


def sheet_kpis(credits: DataFrame) -> DataFrame:
    """Eight (label, value) rows."""
    # ---- fixed values: labels of the rows
    rows = [
        ("Total prêts", "total_prets"),
        ("Taux de défaut (%)", "taux_defaut"),
        ("Nombre de défauts", "nb_defauts"),
        ("Encours total (FCFA)", "encours_total_fcfa"),
        ("Encours en défaut (FCFA)", "encours_defaut_fcfa"),
        ("Perte potentielle LGD 60% (FCFA)", "perte_potentielle_fcfa"),
        ("Montant moyen (FCFA)", "montant_moyen_fcfa"),
        ("Taux d'intérêt moyen (%)", "taux_interet_moyen"),
    ]
    return kpis(credits).select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("Indicateur"), F.col(c).cast("double").alias("Valeur")) for label, c in rows])))


def _sheet_segment(credits: DataFrame, key: str) -> DataFrame:
    return S.totals(S.without_missing(credits, key), key).select(
        key,
        F.col("n_cible").alias("nb_prets"),
        "nb_defauts",
        S.rate_mean().alias("taux_defaut_pct"),
    ).orderBy(F.desc_nulls_last("taux_defaut_pct"), key)


def sheet_sector(credits: DataFrame) -> DataFrame:
    return _sheet_segment(credits, "secteur_activite")


def sheet_product(credits: DataFrame) -> DataFrame:
    return _sheet_segment(credits, "type_produit")


def sheet_class(credits: DataFrame) -> DataFrame:
    return _by_mask_class(credits).select(
        "categorie_cobac",
        F.col("n_cible").alias("nb_credits"),
        "nb_defauts",
        F.col("encours").alias("encours_fcfa"),
        _share_of_rows().alias("part_pct"),
        S.rate_mean().alias("taux_defaut_pct"),
    ).orderBy("categorie_cobac")


def write_workbook(credits: DataFrame, output_dir: str) -> dict[str, DataFrame]:
    """The four sheets as one folder each."""
    sheets = {
        "synthese": sheet_kpis(credits),
        "secteurs": sheet_sector(credits),
        "produits": sheet_product(credits),
        "classes": sheet_class(credits),
    }
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{output_dir}/{name}")
    return sheets


def text_rows(credits: DataFrame, report_date: str | None = None) -> DataFrame:
    """Synthesis sentence and indicator texts, in print order; the report date is passed in, never the clock."""
    k = kpis(credits)
    billions = lambda c: F.format_string("%.2f", F.col(c).cast("double") / 1e9)
    rate = decimal_text("taux_defaut", 2)
    sentence = F.concat(
        thousands("total_prets"), F.lit(" prêts sont suivis ; leur encours est de "), billions("encours_total_fcfa"),
        F.lit(" milliards FCFA. Parmi eux, "), thousands("nb_defauts"), F.lit(" sont en défaut (taux : "), rate,
        F.lit("%), avec un encours de "), billions("encours_defaut_fcfa"), F.lit(" milliards FCFA."))
    rows = [
        ("Synthèse", sentence),
        ("Total prêts", thousands("total_prets")),
        ("Taux de défaut global", F.concat(rate, F.lit(" %"))),
        ("Nombre de défauts", thousands("nb_defauts")),
        ("Encours total", F.concat(billions("encours_total_fcfa"), F.lit(" Mds FCFA"))),
        ("Encours en défaut", F.concat(billions("encours_defaut_fcfa"), F.lit(" Mds FCFA"))),
        ("Perte potentielle (LGD 60%)", F.concat(billions("perte_potentielle_fcfa"), F.lit(" Mds FCFA"))),
        ("Montant moyen", F.concat(
            F.format_string("%.2f", F.col("montant_moyen_fcfa") / 1e6), F.lit(" M FCFA"))),
    ]
    if report_date is not None:
        day = F.date_format(F.to_date(F.lit(report_date)), "dd/MM/yyyy")
        rows.insert(0, ("Date du rapport", day))
    return k.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordre"), F.lit(label).alias("indicateur"), value.alias("valeur"))
        for i, (label, value) in enumerate(rows, 1)])))
