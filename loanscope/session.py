"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Session settings every job relies on; all of them can be changed at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the join is followed by another exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that go to Python at a time: long texts come in batches that two workers of an executor can hold
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "loanscope", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def split_wide_code(spark: SparkSession) -> None:
    """Let stages whose generated method the JVM would not compile (over 8000 bytes) run by their operators, whose code is split.

    For plans that convert or check many columns in one step; it holds for the session from then on and changes no result.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's setting, or one below the warehouse where none is set.

    Without the setting, a warehouse on a local disk is accepted on a local master alone: on a cluster every executor would
    write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        check_reachable(root, spark.sparkContext.master)
    return f"{root.rstrip('/')}/loanscope/{app}"


def check_reachable(root: str, master: str) -> None:
    if root.startswith(("file:", "/")) and not re.match(r"local(\[|$)", master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share; {root} is local to each machine")


def drop_shared(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative estimators cut their lineage there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_root(spark)}/checkpoints")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from the files.

    The plan that follows starts at a columnar scan (short lineage, column pruning, filter pushdown), and a lost
    executor costs nothing because no block lives on it. With ``partition_by`` the parts are separate folders, so a
    filter on that column reads only its part.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
