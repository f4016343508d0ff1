"""Integer codes for categories of any number: a label table built by a distributed rank, and a join.

The labels of a column are the distinct values in text order, numbered from 0. They are dealt into ranges of the order, counted per
range, and numbered within their range; only the counts of the ranges, one for each shuffle partition, reach the driver. Encoding
joins the table: Catalyst broadcasts it where it has measured it as small, and adaptive execution splits a hot label otherwise.

Defined results: a missing category is the label ``nan``; a label that the table does not hold has code -1; an empty table
of rows gives an empty label table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import staged

MISSING_LABEL = "nan"
UNKNOWN_CODE = -1


def label_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """label, code: the distinct labels of a column and their places in text order."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.select(label_of(column).alias("label")).distinct()
    # written once, so that the ranges stay what they were when they were counted
    ranged = staged(distinct.repartitionByRange(parts, "label").withColumn("part", F.spark_partition_id()), "labels")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1
    return ranged.select("label", (place + F.get(F.array(*map(F.lit, offsets)), F.col("part"))).cast("int").alias("code"))


def label_tables(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {c: label_table(df, c) for c in columns}


def encode_labels(df: DataFrame, tables: Mapping[str, DataFrame], suffix: str = "_enc") -> DataFrame:
    """``df`` with the code of every column that has a label table."""
    out = df
    for column, table in tables.items():
        named = table.select(F.col("label").alias(f"_label_{column}"), F.col("code").alias(f"_code_{column}"))
        out = out.join(named, label_of(column) == F.col(f"_label_{column}"), "left").withColumn(
            f"{column}{suffix}", F.coalesce(f"_code_{column}", F.lit(UNKNOWN_CODE))).drop(f"_label_{column}", f"_code_{column}")
    return out
