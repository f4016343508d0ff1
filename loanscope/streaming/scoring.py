"""The scoring service on a stream: read applications, check them, score the valid ones, set the others aside.

``start_scoring`` runs two queries, one for each sink. ``start_scoring_once`` reads the source once: every micro-batch is written to both
sinks under its number and then entered in a ledger. A batch that comes again after a failure overwrites what it had written, and
readers take the batches of the ledger alone, so both sinks show a batch together, whole and once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loanscope.operators.validate import with_violations
from loanscope.plans.service import score_applications
from loanscope.schemas import APPLICATION_SCHEMA
from loanscope.sources.loans import CORRUPT


def read_applications(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Applications arriving as JSON lines in a folder; the text of a line that cannot be read is in ``_corrupt_record``."""
    schema = T.StructType([*APPLICATION_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def start_scoring(
    applications: DataFrame, model: PipelineModel, scored_path: str, rejected_path: str, checkpoint: str,
    available_now: bool = False,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Two append-only queries with their own checkpoints, so that a restart neither loses nor repeats a row."""
    scored, rejected = split_batch(applications, model)
    queries = []
    for name, df, path in (("scored", scored, scored_path), ("rejected", rejected, rejected_path)):
        writer = df.writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{checkpoint}/{name}").option("path", path)
        if available_now:
            writer = writer.trigger(availableNow=True)
        queries.append(writer.start())
    return queries[0], queries[1]


LEDGER_SCHEMA = "batch_id long, received long, scored long, rejected long"


def split_batch(applications: DataFrame, model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """Scored and rejected rows of one batch."""
    broken = F.lit(False)
    readable = applications
    if CORRUPT in applications.columns:
        broken = F.col(CORRUPT).isNotNull()
        readable = applications.filter(~broken).drop(CORRUPT)
    return score_applications(readable, model), with_violations(applications).filter(broken | (F.size("violations") > 0))


def write_batch(applications: DataFrame, batch_id: int, model: PipelineModel, folder: str) -> None:
    """Write one batch to both sinks, then to the ledger; the same batch written again replaces itself.

    The batch is stored first, so the source is read once and a retried sink sees the same rows.
    """
    spark = applications.sparkSession
    received = f"{folder}/received/batch_id={batch_id}"
    applications.write.mode("overwrite").parquet(received)
    rows = spark.read.schema(applications.schema).parquet(received)
    scored, rejected = split_batch(rows, model)
    counts = {}
    for sink, df in (("scored", scored), ("rejected", rejected)):
        path = f"{folder}/{sink}/batch_id={batch_id}"
        write_sink(df, path)
        counts[sink] = spark.read.schema(df.schema).parquet(path).count()
    entry = spark.createDataFrame([(batch_id, rows.count(), counts["scored"], counts["rejected"])], LEDGER_SCHEMA)
    entry.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/entry={batch_id}")


def write_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def start_scoring_once(
    applications: DataFrame, model: PipelineModel, folder: str, checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """One query with both sinks below ``folder``; read them with ``read_sink``."""
    writer = applications.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, model, folder))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, received, scored, rejected of every finished batch."""
    return spark.read.schema(f"{LEDGER_SCHEMA}, entry long").parquet(f"{folder}/ledger").drop("entry")


def read_sink(spark: SparkSession, folder: str, sink: str) -> DataFrame:
    """Rows of ``scored`` or ``rejected`` with their batch_id; batches that are not in the ledger are left out."""
    return spark.read.parquet(f"{folder}/{sink}").join(read_ledger(spark, folder).select("batch_id"), "batch_id", "left_semi")
