"""Table schemas, domain orders, lookup tables and cut-offs of the loan portfolio."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# ---- fixed values: column names, their order and types ------------------------------------------------------
CATEGORICAL = ["ville", "secteur_activite", "type_emploi", "type_produit", "garantie"]

NUMERIC_FEATURES = [
    "age", "anciennete_client_mois", "revenu_mensuel_fcfa", "montant_credit_fcfa", "duree_mois",
    "taux_interet", "ratio_endettement", "nb_incidents_24m", "nb_credits_en_cours", "taux_effort",
]

TARGET = "defaut"

APPLICATION_SCHEMA = T.StructType([
    T.StructField("age", T.IntegerType()),
    T.StructField("ville", T.StringType()),
    T.StructField("secteur_activite", T.StringType()),
    T.StructField("type_emploi", T.StringType()),
    T.StructField("anciennete_client_mois", T.IntegerType()),
    T.StructField("revenu_mensuel_fcfa", T.LongType()),
    T.StructField("type_produit", T.StringType()),
    T.StructField("montant_credit_fcfa", T.LongType()),
    T.StructField("duree_mois", T.IntegerType()),
    T.StructField("taux_interet", T.DoubleType()),
    T.StructField("garantie", T.StringType()),
    T.StructField("nb_incidents_24m", T.IntegerType()),
    T.StructField("nb_credits_en_cours", T.IntegerType()),
])

RAW_SCHEMA = T.StructType(
    [T.StructField("client_id", T.StringType())]
    + APPLICATION_SCHEMA.fields
    + [
        T.StructField("date_octroi", T.TimestampType()),
        T.StructField("ratio_endettement", T.DoubleType()),
        T.StructField("defaut", T.IntegerType()),
        T.StructField("jours_retard", T.IntegerType()),
        T.StructField("classification_cobac", T.StringType()),
        T.StructField("provision_fcfa", T.LongType()),
    ]
)

# Identifier and columns that are causes or consequences of the default.
LEAKAGE_COLUMNS = ["client_id", "date_octroi", "jours_retard", "classification_cobac", "provision_fcfa"]

DERIVED_SCHEMA = T.StructType([
    T.StructField("tranche_age", T.StringType()),
    T.StructField("tranche_revenu", T.StringType()),
    T.StructField("tranche_montant", T.StringType()),
    T.StructField("taux_effort", T.DoubleType()),
    T.StructField("risque_produit", T.DoubleType()),
    T.StructField("revenu_log", T.DoubleType()),
    T.StructField("montant_log", T.DoubleType()),
])

# An integer column is widened to DOUBLE by cleaning when the median that fills its gaps is fractional.
CLEAN_SCHEMA = T.StructType(
    [f for f in RAW_SCHEMA.fields if f.name not in LEAKAGE_COLUMNS] + DERIVED_SCHEMA.fields
)

SCORED_SCHEMA = T.StructType([
    T.StructField("probabilite_defaut", T.DoubleType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("categorie", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("recommandation", T.StringType()),
])


class Bands(NamedTuple):
    """Right-closed bands: value in (edges[i], edges[i+1]] gets labels[i]; None is an open end."""

    edges: tuple
    labels: tuple


# ---- fixed values: band edges and labels -------------------------------------------------------------------
AGE_BANDS = Bands((17, 30, 45, 60, 100), ("18-29", "30-44", "45-59", "60+"))
INCOME_BANDS = Bands((0, 200_000, 500_000, 1_000_000, None), ("<200k", "200-500k", "500k-1M", ">1M"))
AMOUNT_BANDS = Bands((0, 500_000, 2_000_000, 10_000_000, None), ("<500k", "500k-2M", "2M-10M", ">10M"))

# ---- fixed values: risk weights ----------------------------------------------------------------------------
PRODUCT_RISK = {
    "Crédit consommation": 0.25,
    "Crédit immobilier": 0.10,
    "Crédit PME": 0.30,
    "Découvert": 0.20,
    "Crédit auto": 0.15,
    "Crédit scolaire": 0.12,
    "Microfinance": 0.35,
}
SECTOR_RISK = {
    "Commerce": 0.20,
    "BTP": 0.28,
    "Services": 0.15,
    "Agriculture": 0.30,
    "Transport": 0.22,
    "Industrie": 0.14,
    "Pétrole & Gaz": 0.10,
    "Fonction publique": 0.05,
    "Santé": 0.12,
    "Éducation": 0.08,
}

# ---- fixed values: arrears classes (upper bound in days, exclusive) and provision rates --------------------
ARREARS_LIMITS = (("Saine", 1), ("Observation", 90), ("Douteuse", 180), ("Litigieuse", 360))
ARREARS_LAST = "Irrecouvrable"
PROVISION_RATES = {
    "Saine": 0.0,
    "Observation": 0.05,
    "Douteuse": 0.30,
    "Litigieuse": 0.50,
    "Irrecouvrable": 1.0,
}
CLASS_ORDER = ("Saine", "Observation", "Douteuse", "Litigieuse")

# ---- fixed values: score grades and decisions, (cut-off, label) from best to worst; None is the rest -------
GRADES_V1 = (
    (800, "A - Excellent"), (650, "B - Bon"), (500, "C - Moyen"), (350, "D - Risqué"), (None, "E - Très risqué"),
)
GRADES_V2 = (
    (800, "A - Excellent"), (700, "B - Bon"), (587, "C - Moyen"), (400, "D - Risqué"), (None, "E - Très risqué"),
)
DECISIONS_V1 = ((650, "ACCEPTÉ"), (500, "À EXAMINER"), (None, "REFUSÉ"))
DECISIONS_V2 = ((724, "ACCEPTÉ"), (587, "À EXAMINER"), (None, "REFUSÉ"))
RECOMMENDATIONS = {
    "ACCEPTÉ": (
        "Client éligible. Taux de défaut observé sur ce segment : 2,7%. "
        "Procéder à l'octroi selon les conditions standards."
    ),
    "À EXAMINER": (
        "Dossier à examiner par le comité. Taux de défaut observé : 9,7%. "
        "Vérifier les garanties et l'historique relationnel."
    ),
    "REFUSÉ": (
        "Profil à risque élevé. Taux de défaut observé : 58,8%. "
        "Refus recommandé ou demande de garanties exceptionnelles."
    ),
}

# ---- fixed values: loss given default, calibration quantiles, score bands ----------------------------------
LGD = 0.6
ACCEPT_QUANTILE = 0.65
REFUSE_QUANTILE = 0.30
SCORE_BANDS = Bands(
    (-1, 400, 500, 600, 700, 800, 1000),
    ("[0,400]", "(400,500]", "(500,600]", "(600,700]", "(700,800]", "(800,1000]"),
)

# ---- fixed values: names and sizes of the three models ----------------------------------------------------------
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient Boosting"
MODEL_NAMES = (LOGISTIC, FOREST, BOOSTED)
LOGISTIC_ITERATIONS = 2000
FOREST_TREES, FOREST_DEPTH = 200, 12
BOOSTED_ROUNDS, BOOSTED_DEPTH, BOOSTED_RATE = 300, 6, 0.05
MODEL_SEED = 42

# ---- fixed values: columns that tell one clean loan from another ---------------------------------------------------
IDENTITY = [
    "age", "ville", "secteur_activite", "type_emploi", "anciennete_client_mois", "revenu_mensuel_fcfa",
    "type_produit", "montant_credit_fcfa", "duree_mois", "garantie", "nb_incidents_24m", "nb_credits_en_cours",
    TARGET,
]

# ---- fixed values: columns that the correlations leave out ---------------------------------------------------------
REDUNDANT = ("revenu_log", "montant_log", "risque_produit")
