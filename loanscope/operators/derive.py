"""Derivations on raw loans: identifiers, ratios, risk weights, label, arrears, provisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import clip, col, half_even, lookup
from loanscope.functions.rules import class_by_arrears, debt_ratio, provision
from loanscope.operators.order_stats import quantile
from loanscope.schemas import PRODUCT_RISK, SECTOR_RISK, TARGET


def client_id(number: str | Column, prefix: str, width: int = 6) -> Column:
    """Prefix and zero-padded number; a longer number is kept whole (lpad alone would cut it)."""
    text = col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def raw_debt_ratio() -> Column:
    """Debt ratio of a raw loan: bounded to [0, 3], 3 decimals."""
    return half_even(clip(debt_ratio(), 0.0, 3.0), 3)


def product_risk(table: Mapping[str, float] = PRODUCT_RISK) -> Column:
    return lookup("type_produit", table)


def sector_risk(table: Mapping[str, float] = SECTOR_RISK) -> Column:
    return lookup("secteur_activite", table)


def risk_score(product: Column, sector: Column, ratio: Column, noise: Column | None = None) -> Column:
    """Weighted composite risk score; an unknown tenure counts as not recent."""
    recent = F.when(F.col("anciennete_client_mois") < 12, 1.0).otherwise(0.0)
    score = (
        product * F.lit(0.35) + sector * F.lit(0.20) + ratio * F.lit(0.20)
        + F.col("nb_incidents_24m").cast("double") * F.lit(0.15) + recent * F.lit(0.10)
    )
    return score if noise is None else score + noise


def label_above_quantile(df: DataFrame, score: str, p: float = 0.78, target: str = TARGET) -> DataFrame:
    """Label 1 for scores strictly above their exact quantile. The threshold is a literal, so the plan stays flat."""
    threshold = quantile(df, score, p)
    if threshold is None:
        return df.withColumn(target, F.lit(None).cast("int"))
    return df.withColumn(target, F.coalesce((F.col(score) > F.lit(threshold)).cast("int"), F.lit(0)))


def arrears_days(draw: Column, target: str = TARGET) -> Column:
    """Days past due: the draw for loans in default, 0 for the others."""
    return F.when(F.col(target) == 1, draw).otherwise(F.lit(0)).cast("int")


def with_arrears_class(df: DataFrame) -> DataFrame:
    return df.withColumn("classification_cobac", class_by_arrears("jours_retard")).withColumn(
        "provision_fcfa", provision("montant_credit_fcfa", "classification_cobac"))


def provision_by_class(df: DataFrame) -> DataFrame:
    return df.groupBy("classification_cobac").agg(
        F.count(F.lit(1)).alias("nb_credits"),
        F.sum("montant_credit_fcfa").alias("encours_fcfa"),
        F.sum("provision_fcfa").alias("provision_fcfa"),
    )


def grant_date(index: str | Column, start: str = "2022-01-01", step_hours: int = 3) -> Column:
    """Evenly spaced dates: start + index * step."""
    first = F.unix_timestamp(F.lit(f"{start} 00:00:00"))
    return F.timestamp_seconds(first + col(index).cast("bigint") * (step_hours * 3600))
