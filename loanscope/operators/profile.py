"""Data profile of a table: shape, types, gaps, copies, target, numeric and categorical statistics.

Each section is one aggregate whose single row is unfolded into one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import half_even, pct
from loanscope.operators.order_stats import quantiles
from loanscope.schemas import TARGET


def _unfold(df: DataFrame, rows: list[list[Column]]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(*r) for r in rows])))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _textual(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_lignes")).withColumn("n_colonnes", F.lit(len(df.columns)))


def dtypes(df: DataFrame) -> DataFrame:
    """Columns per type, with the number of values present in them."""
    kinds: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        kinds.setdefault(kind, []).append(name)
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        [F.lit(kind).alias("type"), F.lit(len(cs)).alias("nb_colonnes"),
         sum((F.col(c) for c in cs[1:]), F.col(cs[0])).alias("nb_valeurs")]
        for kind, cs in kinds.items()
    ]
    return _unfold(one, rows).orderBy(F.desc("nb_colonnes"), "type")


def missing(df: DataFrame) -> DataFrame:
    """Columns with gaps: count and percentage, largest share first."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [
        [F.lit(c).alias("colonne"), F.col(c).alias("manquants"),
         half_even(pct(F.col(c), F.col("_n")), 2).alias("pourcentage")]
        for c in df.columns
    ]
    return _unfold(one, rows).filter("manquants > 0").orderBy(F.desc("pourcentage"), "colonne")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Copies are counted map-side, so a hot row costs one row per task."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("doublons"), F.sum("_copies").alias("_n"),
    ).select("doublons", half_even(pct(F.col("doublons"), F.col("_n")), 2).alias("pourcentage"))


def target_distribution(df: DataFrame, target: str = TARGET) -> DataFrame | None:
    """Rows per target value with their share and the overall default rate; None when the column is absent."""
    if target not in df.columns:
        return None
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("nb"))
    # over the few target values, not over the loans
    whole = F.sum("nb").over(Window.partitionBy())
    known = F.sum(F.when(F.col(target).isNotNull(), F.col("nb"))).over(Window.partitionBy())
    positive = F.sum(F.col(target).cast("double") * F.col("nb")).over(Window.partitionBy())
    return (
        counts.withColumn("_all", whole)
        .withColumn("taux_defaut", F.try_divide(positive, known.cast("double")) * 100)
        .filter(F.col(target).isNotNull())
        .select(
            F.col(target).alias("valeur"),
            F.when(F.col(target) == 0, "Sain").otherwise("Défaut").alias("libelle"),
            "nb",
            half_even(pct(F.col("nb"), F.col("_all")), 2).alias("pourcentage"),
            "taux_defaut",
        )
        .orderBy("valeur")
    )


def numeric_stats(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, min, exact median and max per numeric column, 2 decimals."""
    names = _numeric(df)
    medians = quantiles(df, {c: [0.5] for c in names})
    aggs = []
    for c in names:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}.mean"), F.stddev_samp(v).alias(f"{c}.std"),
                 F.min(v).alias(f"{c}.min"), F.max(v).alias(f"{c}.max")]
    one = df.agg(*aggs)
    rows = [
        [F.lit(c).alias("colonne"),
         half_even(F.col(f"`{c}.mean`"), 2).alias("mean"),
         half_even(F.col(f"`{c}.std`"), 2).alias("std"),
         half_even(F.col(f"`{c}.min`"), 2).alias("min"),
         half_even(F.lit(medians[(c, 0.5)]).cast("double"), 2).alias("mediane"),
         half_even(F.col(f"`{c}.max`"), 2).alias("max")]
        for c in names
    ]
    return _unfold(one, rows)


def _distinct_counts(df: DataFrame, columns: list[str], approximate: bool) -> DataFrame:
    """Distinct non-null values per column.

    Exact counts group (column, value) pairs, spread over the cluster by pair, so a frequent value collapses map-side
    and a column of unique values does not land on one task.
    """
    if approximate:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return _unfold(one, [[F.lit(c).alias("colonne"), F.col(c).alias("nb_uniques")] for c in columns])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = (
        df.select(F.inline(pairs)).distinct().groupBy("i").agg(F.count("v").alias("nb_uniques"))
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return counts.select(name.alias("colonne"), "nb_uniques")


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values of every text column."""
    return _distinct_counts(df, _textual(df), approximate).orderBy("colonne")


def constants(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; a column of gaps only counts too.

    One value means min = max, so no distinct count is needed.
    """
    one = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(df.columns)],
                 *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(df.columns)])
    rows = [
        [F.lit(c).alias("colonne"), F.col(f"lo_{i}").eqNullSafe(F.col(f"hi_{i}")).alias("constante"),
         F.col(f"lo_{i}").isNotNull().cast("int").alias("nb_uniques")]
        for i, c in enumerate(df.columns)
    ]
    return _unfold(one, rows).filter("constante").select("colonne", "nb_uniques").orderBy("colonne")


def full_profile(df: DataFrame, target: str = TARGET) -> dict[str, DataFrame]:
    sections = {
        "dimensions": shape(df), "types": dtypes(df), "missing": missing(df), "doublons": duplicates(df),
        "cible": target_distribution(df, target), "numeriques": numeric_stats(df),
        "cardinalite": cardinality(df), "constantes": constants(df),
    }
    return {name: section for name, section in sections.items() if section is not None}
