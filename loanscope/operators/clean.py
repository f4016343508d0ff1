"""Cleaning and feature engineering.

The steps are sequential: each percentile is taken over the rows that survived the step before. Thresholds and medians
come back as single numbers and re-enter the plan as literals, so the final plan is one scan, one filter, one
deduplication and one projection, whose range filters reach the file scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import at_most, banded, half_even, lookup, null_if_nan
from loanscope.functions.rules import debt_ratio
from loanscope.operators.order_stats import SeriesSet, quantile, quantiles
from loanscope.schemas import (
    AGE_BANDS,
    AMOUNT_BANDS,
    INCOME_BANDS,
    LEAKAGE_COLUMNS,
    PRODUCT_RISK,
    TARGET,
)
from loanscope.session import staged

AGE_RANGE = (18, 80)
INCOME_FLOOR, INCOME_QUANTILE = 50_000, 0.99
AMOUNT_FLOOR, AMOUNT_QUANTILE = 100_000, 0.995
RATIO_RANGE = (0.0, 1.5)


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*LEAKAGE_COLUMNS)


@dataclass(frozen=True)
class Thresholds:
    """Upper bounds found on the data; None when no row is left to take a percentile of."""

    income_high: float | None
    amount_high: float | None


def age_valid() -> Column:
    return F.col("age").between(*AGE_RANGE)


def _at_most(c: str, bound: float | None) -> Column:
    return at_most(c, bound) if bound is not None else F.lit(False)


def income_valid(t: Thresholds) -> Column:
    return (F.col("revenu_mensuel_fcfa") >= INCOME_FLOOR) & _at_most("revenu_mensuel_fcfa", t.income_high)


def amount_valid(t: Thresholds) -> Column:
    return (F.col("montant_credit_fcfa") >= AMOUNT_FLOOR) & _at_most("montant_credit_fcfa", t.amount_high)


def ratio_valid() -> Column:
    return F.col("ratio_endettement").between(*RATIO_RANGE)


def find_thresholds(raw: DataFrame) -> Thresholds:
    """p99 of income among valid ages, then p99.5 of amount among valid ages and incomes; both exact."""
    aged = raw.filter(age_valid())
    income_high = quantile(aged, "revenu_mensuel_fcfa", INCOME_QUANTILE)
    found = Thresholds(income_high, None)
    amount_high = quantile(aged.filter(income_valid(found)), "montant_credit_fcfa", AMOUNT_QUANTILE)
    return Thresholds(income_high, amount_high)


def filtered(raw: DataFrame, t: Thresholds) -> DataFrame:
    """Rows in range in every step; a missing value drops the row."""
    return raw.filter(age_valid() & income_valid(t) & amount_valid(t) & ratio_valid())


def deduplicated(df: DataFrame) -> DataFrame:
    """Full-row deduplication. Copies collapse map-side before the exchange, so a hot row costs one row per task."""
    return df.dropDuplicates()


def deduplicated_first(df: DataFrame, position: str = "date_octroi") -> DataFrame:
    """Deduplication over the columns left once identifiers are dropped, keeping the first position of each row."""
    keys = [c for c in df.columns if c not in LEAKAGE_COLUMNS]
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def with_features(df: DataFrame, product_risk: Mapping[str, float] = PRODUCT_RISK) -> DataFrame:
    """Recomputed debt ratio (3 dp, unbounded), bands, effort rate in percent (2 dp), product weight and logs."""
    ratio = debt_ratio()
    return df.withColumns({
        "ratio_endettement": half_even(ratio, 3),
        "tranche_age": banded("age", AGE_BANDS),
        "tranche_revenu": banded("revenu_mensuel_fcfa", INCOME_BANDS),
        "tranche_montant": banded("montant_credit_fcfa", AMOUNT_BANDS),
        "taux_effort": half_even(ratio * 100, 2),
        "risque_produit": lookup("type_produit", product_risk),
        "revenu_log": half_even(F.log1p(F.col("revenu_mensuel_fcfa").cast("double")), 3),
        "montant_log": half_even(F.log1p(F.col("montant_credit_fcfa").cast("double")), 3),
    })


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill the gaps of numeric columns with their exact median; texts keep their gaps.

    A column without gaps is left alone. An integer column becomes DOUBLE when its median is fractional.
    """
    columns = _numeric(df) if columns is None else columns
    if not columns:
        return df
    search = SeriesSet(df, {c: None for c in columns})
    extent = search.measure()  # counts, minima and maxima of all columns in one pass
    holed = [c for c in columns if 0 < extent[c][0] < search.table_rows]
    medians = quantiles(df, {c: [0.5] for c in holed}, extent={c: extent[c] for c in holed}) if holed else {}
    fills = {}
    for c in holed:
        m = medians[(c, 0.5)]
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            whole = m == int(m)
            fills[c] = F.coalesce(F.col(c), F.lit(int(m)).cast(kind)) if whole else F.coalesce(
                F.col(c).cast("double"), F.lit(m))
        else:
            fills[c] = F.coalesce(null_if_nan(F.col(c).cast("double")), F.lit(m))
    return df.withColumns(fills) if fills else df


@dataclass(frozen=True)
class CleanResult:
    credits: DataFrame
    thresholds: Thresholds
    raw: DataFrame
    dated: DataFrame | None = None  # the clean rows with the date of their first occurrence

    def report(self) -> DataFrame:
        return clean_report(self.raw, self.credits, self.thresholds)


def clean(raw: DataFrame, product_risk: Mapping[str, float] = PRODUCT_RISK) -> CleanResult:
    """Raw loans to clean loans. The deduplicated rows are written once; imputation is a view over them."""
    found = find_thresholds(raw)
    kept = filtered(raw, found)
    dated = "date_octroi" in raw.columns
    kept = deduplicated_first(kept) if dated else deduplicated(drop_leakage(kept))
    stage = staged(with_features(kept, product_risk), "credits")
    filled = impute_median(stage)
    return CleanResult(filled.drop("date_octroi"), found, raw, filled if dated else None)


def clean_report(raw: DataFrame, credits: DataFrame, t: Thresholds) -> DataFrame:
    """Rows dropped per step, rows in and out, retention and default rate, as one row.

    Every raw row is charged to the first step it fails in one pass; copies are what the filters leave beyond the
    clean table.
    """
    failed = (
        F.when(~F.coalesce(age_valid(), F.lit(False)), 2)
        .when(~F.coalesce(income_valid(t), F.lit(False)), 3)
        .when(~F.coalesce(amount_valid(t), F.lit(False)), 4)
        .when(~F.coalesce(ratio_valid(), F.lit(False)), 5)
        .otherwise(0)
    )
    steps = raw.select(failed.alias("step")).agg(
        F.count(F.lit(1)).alias("n_initial"),
        F.count_if(F.col("step") == 2).alias("filtrage_age"),
        F.count_if(F.col("step") == 3).alias("filtrage_revenus"),
        F.count_if(F.col("step") == 4).alias("filtrage_montants"),
        F.count_if(F.col("step") == 5).alias("filtrage_ratio"),
        F.count_if(F.col("step") == 0).alias("_kept"),
    )
    final = credits.agg(F.count(F.lit(1)).alias("n_final"), F.avg(TARGET).alias("_rate"))
    dropped = len([c for c in LEAKAGE_COLUMNS if c in raw.columns])
    # both sides are one-row aggregates
    return steps.crossJoin(F.broadcast(final)).select(
        "n_initial",
        F.lit(dropped).alias("colonnes_supprimees"),
        "filtrage_age", "filtrage_revenus", "filtrage_montants", "filtrage_ratio",
        (F.col("_kept") - F.col("n_final")).alias("doublons_supprimes"),
        "n_final",
        (F.col("n_initial") - F.col("n_final")).alias("lignes_supprimees"),
        half_even(F.try_divide(F.col("n_final").cast("double"), F.col("n_initial").cast("double")) * 100, 2)
        .alias("taux_conservation"),
        half_even(F.col("_rate") * 100, 2).alias("taux_defaut"),
    )
