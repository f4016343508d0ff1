"""A corpus pipeline: toxic documents go, repeated lines go, near duplicates go, benchmark leaks go, sources are mixed.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that ``run`` writes
as Parquet in the shared folder and reads again for the next one. All but the last return the columns of ``documents``.

* toxicity: documents that the model, fitted on ``labels``, predicts as toxic are dropped.
* line_dedup: later copies of repeated content-defined chunks of lines, compared byte for byte, are cut out of the texts, with the
  repeated passages of two lines or more that chunk boundaries cut through, and n_chars follows.
* simhash: of each group of near duplicates the document with the smallest id stays; fingerprints of NEAR_BITS differing bits are
  near, which takes in more of the copies with a few changed words than the operator's own default.
* decontamination: documents that contain a benchmark item are dropped.
* mixing: one row for each document and epoch that the budget of its source takes, with domain, n_tokens, epoch.

Null or empty texts pass the first two stages, are one group of equal documents in the third, and take no part in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from loanscope.llm.common import table
from loanscope.session import staged


NEAR_BITS = 6


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, radius=NEAR_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
