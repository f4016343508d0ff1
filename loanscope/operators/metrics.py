"""Exact classification metrics.

Ranking metrics need, for every distinct score, how many positives and negatives score at least as high. Rows are
first counted per distinct score (map-side partial). The running sums then go over disjoint score ranges: the range
bounds are quantiles of the distinct scores, each range is summed on its own, and the totals of the higher ranges (one
row per range) are added back. No task sees more than its range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import col
from loanscope.session import staged



def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: true negatives, false positives, false negatives, true positives; absent combinations are 0."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("vrais_negatifs"),
        F.count_if((y == 0) & (p == 1)).alias("faux_positifs"),
        F.count_if((y == 1) & (p == 0)).alias("faux_negatifs"),
        F.count_if((y == 1) & (p == 1)).alias("vrais_positifs"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _class_scores(hit: str, wrong: str, lost: str) -> tuple[Column, Column, Column, Column]:
    tp, fp, fn = F.col(hit), F.col(wrong), F.col(lost)
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    c = confusion_counts(df, label, prediction)
    p0, r0, f0, n0 = _class_scores("vrais_negatifs", "faux_negatifs", "faux_positifs")
    p1, r1, f1, n1 = _class_scores("vrais_positifs", "faux_positifs", "faux_negatifs")
    n = n0 + n1
    accuracy = _ratio(F.col("vrais_negatifs") + F.col("vrais_positifs"), n)

    def row(name: str, precision: Column, recall: Column, f1_score: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("classe"), precision.alias("precision"), recall.alias("recall"),
                        f1_score.alias("f1_score"), support.cast("bigint").alias("support"))

    def weighted(a: Column, b: Column) -> Column:
        return _ratio(a * n0 + b * n1, n)

    return c.select(F.inline(F.array(
        row("0", p0, r0, f0, n0),
        row("1", p1, r1, f1, n1),
        row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
    )))


def _ranges(df: DataFrame, c: str) -> list[float]:
    """Bounds that cut the distinct values of a column into about equal parts, one per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the error allowed is a tenth of a range, however many ranges there are
    inner = sorted(set(df.approxQuantile(c, [i / parts for i in range(1, parts)], 0.1 / parts)))
    return [-math.inf, *inner, math.inf]


def score_curve(df: DataFrame, probability: str | Column, label: str = "label") -> DataFrame:
    """Per distinct score: positives and negatives at it (pos, neg) and strictly above it (pos_above, neg_above)."""
    y = F.col(label)
    by_score = staged(
        df.select(col(probability).cast("double").alias("score"), y.alias("y"))
        .filter(F.col("score").isNotNull() & F.col("y").isNotNull())
        .groupBy("score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")),
        "score_counts",
    )
    bounds = _ranges(by_score, "score")
    if len(bounds) > 2:
        ranged = Bucketizer(splits=bounds, inputCol="score", outputCol="range").transform(by_score)
    else:
        ranged = by_score.withColumn("range", F.lit(0.0))
    # one row per range: a window over at most as many rows as there are shuffle partitions
    higher = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "range",
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("pos_higher"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("neg_higher"))
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select(
        "range", "score", "pos", "neg",
        F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("pos_in"),
        F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("neg_in"))
    return within.join(F.broadcast(offsets), "range").select(
        "score", "pos", "neg",
        (F.col("pos_in") + F.col("pos_higher")).alias("pos_above"),
        (F.col("neg_in") + F.col("neg_higher")).alias("neg_above"))


def ranking_metrics(df: DataFrame, probability: str | Column, label: str = "label") -> DataFrame:
    """One row: ROC area (ties count half) and step-wise average precision; null without both classes / positives."""
    curve = score_curve(df, probability, label)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    sums = curve.agg(
        F.sum(neg * (F.col("pos_above").cast("double") + pos / 2)).alias("area"),
        F.sum(pos * (tp.cast("double") / (tp + fp).cast("double"))).alias("precision_sum"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    )
    return sums.select(
        F.try_divide(F.col("area"), F.col("p") * F.col("n")).alias("auc"),
        F.try_divide(F.col("precision_sum"), F.col("p")).alias("avg_precision"))
