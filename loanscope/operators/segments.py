"""Portfolio aggregates over any segment.

Every report is a finishing projection over one frame of additive totals per segment. The totals are plain grouped
sums (map-side partial, then one exchange of one row per segment and task); the optimizer drops the sums a report
does not read. Shares of the total are taken over the segment rows, never over the loans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import HASH_RANGE, below, col, half_away, half_even, pct, rank_in
from loanscope.operators.order_stats import SeriesSet, not_after, pair_cuts, quantile
from loanscope.schemas import LGD, REDUNDANT, TARGET

AMOUNT = "montant_credit_fcfa"


def _when_default(c: str) -> Column:
    return F.when(F.col(TARGET) == 1, F.col(c)).otherwise(F.lit(0).cast("bigint"))


_AVERAGED = {
    "taux_interet": "double", "taux_effort": "double", "revenu_mensuel_fcfa": "bigint", "duree_mois": "bigint",
}
TOTAL_NAMES = ["n", "n_cible", "nb_defauts", "encours", "n_encours", "encours_defaut", "nb_incidents"] + [
    f"{kind}_{c}" for c in _AVERAGED for kind in ("s", "n")]


def total_columns() -> list[Column]:
    out = [
        F.count(F.lit(1)).alias("n"),
        F.count(TARGET).alias("n_cible"),
        F.sum(F.col(TARGET).cast("bigint")).alias("nb_defauts"),
        F.sum(F.col(AMOUNT).cast("bigint")).alias("encours"),
        F.count(AMOUNT).alias("n_encours"),
        F.sum(_when_default(AMOUNT).cast("bigint")).alias("encours_defaut"),
        F.sum(F.col("nb_incidents_24m").cast("bigint")).alias("nb_incidents"),
    ]
    for c, kind in _AVERAGED.items():
        out += [F.sum(F.col(c).cast(kind)).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    return out


def totals(df: DataFrame, *keys: str) -> DataFrame:
    """Additive totals per segment; a missing key forms its own segment, as in SQL."""
    return df.groupBy(*keys).agg(*total_columns())


def _resummed() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOTAL_NAMES]


def retotalled(t: DataFrame, *keys: str) -> DataFrame:
    """Totals of a coarser segmentation from those of a finer one; the loans are not read again."""
    return t.groupBy(*keys).agg(*_resummed())


def _sets(df: DataFrame, key_sets: Sequence[Sequence[str]], aggregates: list[Column]) -> DataFrame:
    keys = list(dict.fromkeys(k for ks in key_sets for k in ks))
    grouped = df.groupingSets([[F.col(k) for k in ks] for ks in key_sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id(*keys).alias("_gid"), *aggregates)
    number = None
    for i, ks in enumerate(key_sets):
        gid = sum(1 << (len(keys) - 1 - p) for p, k in enumerate(keys) if k not in ks)
        number = F.when(F.col("_gid") == gid, i) if number is None else number.when(F.col("_gid") == gid, i)
    return grouped.withColumn("ensemble", number).drop("_gid")


def grouped_totals(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Totals of several segmentations in one pass over the loans; ``ensemble`` numbers the key set of a row.

    Every loan is counted once per key set, so pass few, fine sets and derive the coarse ones with ``retotalled``.
    """
    return _sets(df, key_sets, total_columns())


def regrouped_totals(t: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same over totals of a finer segmentation."""
    return _sets(t, key_sets, _resummed())


def without_missing(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows with a missing key, as a data-frame group-by does."""
    return df.dropna(subset=list(keys)) if keys else df


# ---- measures over totals ----------------------------------------------------------------------------------

def rate_sql(digits: int = 2) -> Column:
    """Default rate in percent over all rows, rounded half away."""
    return half_away(pct(F.col("nb_defauts"), F.col("n")), digits)


def rate_mean(digits: int = 2) -> Column:
    """Default rate in percent over rows with a known label, rounded half to even."""
    return half_even(mean_default() * 100, digits)


def mean_default() -> Column:
    return F.try_divide(F.col("nb_defauts").cast("double"), F.col("n_cible").cast("double"))


def mean_of(c: str) -> Column:
    if c == AMOUNT:
        return F.try_divide(F.col("encours").cast("double"), F.col("n_encours").cast("double"))
    return F.try_divide(F.col(f"s_{c}").cast("double"), F.col(f"n_{c}").cast("double"))


def scaled(c: str, unit: float, digits: int) -> Column:
    return half_away(F.col(c).cast("double") / F.lit(unit), digits)


def share_of_total(c: str) -> Column:
    """Percent of the sum over all segment rows."""
    return pct(F.col(c), F.sum(c).over(Window.partitionBy()))


def loss() -> Column:
    return F.col("encours_defaut").cast("double") * F.lit(LGD)


# ---- generic reports ---------------------------------------------------------------------------------------

def segment_default_rate(df: DataFrame, segment: str, order: Sequence[str] | None = None) -> DataFrame:
    """Loans, mean and default rate per segment, optionally in an explicit category order."""
    out = totals(without_missing(df, segment), segment).select(
        segment, F.col("n_cible").alias("nb_prets"), mean_default().alias("mean"), rate_mean().alias("taux_defaut"))
    if order:
        return out.orderBy(rank_in(segment, order).asc_nulls_last())
    return out.orderBy(segment)


def crosstab(df: DataFrame, first: str, second: str) -> DataFrame:
    """Default rate per pair of categories."""
    return totals(without_missing(df, first, second), first, second).select(
        first, second, mean_default().alias(TARGET), rate_mean().alias("taux_defaut"))


def crosstab_wide(df: DataFrame, first: str, second: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The same as a matrix: one row per first category, one column per second category.

    The pivot works on the pair totals, so the loans are aggregated once and before any widening. Without ``columns``
    the values are those of the table (Spark refuses more than ``spark.sql.pivotMaxValues``); with them, a value that
    has no column is an error.
    """
    pairs = crosstab(df, first, second)
    if columns:
        known = F.col(second).isin(list(columns))
        unknown = F.raise_error(F.concat(F.lit(f"{second} has a value without a column: "), F.col(second)))
        pivot = pairs.withColumn(second, F.when(known, F.col(second)).otherwise(unknown)).groupBy(first).pivot(second, list(columns))
    else:
        pivot = pairs.groupBy(first).pivot(second)
    return pivot.agg(F.first("taux_defaut"))


def crosstab_sparse(df: DataFrame, first: str, second: str) -> DataFrame:
    """The matrix as one map per first category, from second category to default rate: no column list, no pivot limit.

    Built from the pair totals, so a map gathers one entry per second category, never loans.
    """
    pairs = crosstab(df, first, second)
    entries = F.array_sort(F.collect_list(F.struct(F.col(second).alias("key"), F.col("taux_defaut").alias("value"))))
    return pairs.groupBy(first).agg(entries.alias("entries")).select(first, F.map_from_entries("entries").alias("taux_defaut"))


def histogram(df: DataFrame, c: str, bins: int = 50, below_quantile: float | None = None) -> DataFrame:
    """Equal-width histogram split by the default flag, over the values strictly below a quantile if one is given."""
    if below_quantile is not None:
        cut = quantile(df, c, below_quantile)
        df = df.filter(below(c, cut)) if cut is not None else df.limit(0)
    n, low, high = SeriesSet(df, {c: None}).measure()[c]
    if n == 0:
        low, high = 0, 0
    width = float(high - low) / bins
    x = F.col(c).cast("double") - F.lit(float(low))
    index = F.least(F.floor(x / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return (
        df.filter(F.col(c).isNotNull())
        .groupBy(index.cast("int").alias("bin"), TARGET)
        .agg(F.count(F.lit(1)).alias("nb"))
        .select(
            "bin",
            (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("borne_basse"),
            (F.lit(float(low)) + (F.col("bin") + 1) * F.lit(width)).alias("borne_haute"),
            TARGET, "nb")
    )


def correlation(df: DataFrame, target: str = TARGET, excluded: Sequence[str] = REDUNDANT) -> DataFrame:
    """Pearson correlation of every numeric column with the target, ascending; one pass, n correlations."""
    names = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded and f.name != target
    ]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in names])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("correlation")) for c in names]))
    return one.select(rows).orderBy(F.col("correlation").asc_nulls_last(), "variable")


def decile_evolution(df: DataFrame, position: str | Column, tie_break: str | Column, buckets: int = 10) -> DataFrame:
    """Default rate per quantile bucket of the row position in (position, tie_break) order.

    The bucket bounds are order statistics, found exactly without sorting; rows are then bucketed by comparison. Rows
    that agree on both columns share a bucket. The tie-break is a row hash.
    """
    # the hash is worked out once per row here, not once per comparison
    rows = df.select(col(position).alias("position"), col(tie_break).alias("tie"), TARGET).filter(
        F.col("position").isNotNull())
    cuts = pair_cuts(
        rows, "position", "tie", lambda n: [b * (n - 1) // buckets for b in range(1, buckets)] if n else [], HASH_RANGE)
    bucket = F.lit(buckets - 1)
    for b in reversed(range(len(cuts))):
        bucket = F.when(not_after("position", "tie", cuts[b]), b).otherwise(bucket)
    return (
        rows.groupBy(bucket.alias("bucket"))
        .agg(F.count(TARGET).alias("nb_prets"), F.avg(TARGET).alias("mean"))
        .withColumn("taux_defaut", half_even(F.col("mean") * 100, 2))
        .orderBy("bucket")
    )
