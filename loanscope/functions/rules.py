"""Business rules as column expressions: classes, grades, decisions, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanscope.functions.expressions import by_cutoffs, col, half_even, lookup
from loanscope.schemas import (
    ARREARS_LAST,
    ARREARS_LIMITS,
    DECISIONS_V2,
    GRADES_V2,
    PROVISION_RATES,
    RECOMMENDATIONS,
)


def instalment(amount: str | Column = "montant_credit_fcfa", months: str | Column = "duree_mois") -> Column:
    return F.try_divide(col(amount).cast("double"), col(months).cast("double"))


def debt_ratio(income: str | Column = "revenu_mensuel_fcfa", **kwargs) -> Column:
    """Instalment over income, not rounded and not bounded; null when a part is missing or a divisor is zero."""
    return F.try_divide(instalment(**kwargs), col(income).cast("double"))


def class_by_arrears(days: str | Column) -> Column:
    """Regulatory class by days past due."""
    days = col(days)
    out = None
    for label, limit in ARREARS_LIMITS:
        out = F.when(days < limit, label) if out is None else out.when(days < limit, label)
    return out.when(days.isNotNull(), ARREARS_LAST)


def provision(amount: str | Column, arrears_class: str | Column) -> Column:
    return half_even(col(amount).cast("double") * lookup(arrears_class, PROVISION_RATES), 0).cast("bigint")


def classify_sql(effort: str | Column = "taux_effort", incidents: str | Column = "nb_incidents_24m") -> Column:
    """Portfolio class, report rule: first matching line wins, an unknown effort with no incident falls through."""
    e, i = col(effort), col(incidents)
    return (
        F.when((e < 30) & (i == 0), "1. Saine")
        .when((e < 40) & (i == 0), "2. Observation")
        .when((e < 50) | (i == 1), "3. Douteuse")
        .otherwise("4. Litigieuse")
    )


def classify_masks(effort: str | Column = "taux_effort", incidents: str | Column = "nb_incidents_24m") -> Column:
    """Portfolio class, mask rule: start from Saine, later masks overwrite earlier ones (so they are tested first)."""
    e, i = col(effort), col(incidents)
    return (
        F.when((e >= 50) & (i == 1), "Litigieuse")
        .when((e >= 40) | (i == 1), "Douteuse")
        .when((e >= 30) & (i == 0), "Observation")
        .otherwise("Saine")
    )


def score_rounded(p: str | Column) -> Column:
    """0 (worst) to 1000 (best), rounded half to even: batch scoring and calibration."""
    return half_even((F.lit(1.0) - col(p)) * 1000, 0).cast("int")


def score_truncated(p: str | Column) -> Column:
    """0 (worst) to 1000 (best), truncated: scoring of applications."""
    return F.floor((F.lit(1.0) - col(p)) * 1000).cast("int")


def grade(score: str | Column, cutoffs=GRADES_V2) -> Column:
    return by_cutoffs(score, cutoffs)


def decision(score: str | Column, cutoffs=DECISIONS_V2) -> Column:
    return by_cutoffs(score, cutoffs)


def recommendation(decision_label: str | Column) -> Column:
    d = col(decision_label)
    out = None
    for label, text in RECOMMENDATIONS.items():
        out = F.when(d == label, text) if out is None else out.when(d == label, text)
    return out
