"""Session helper for tests and benches, and the shared folder for staged tables."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str, cores: str = "8", **conf: str) -> SparkSession:
    """A single-machine session; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder, else its warehouse.

    On a cluster a warehouse on the local disk, which is what Spark has by default, is refused: every
    machine would write to its own.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = not warehouse.startswith("/") and ":" not in warehouse or warehouse.startswith(("/", "file:"))
    if local and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all machines share")
    return warehouse.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    application = spark.sparkContext.applicationId
    return os.path.join(
        shared_folder(spark), "touchline-stage", application, f"{label}-{uuid.uuid4().hex}"
    )


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stage(spark: SparkSession) -> None:
    """Delete what this application staged; call it when its results have been written."""
    application = spark.sparkContext.applicationId
    _delete(spark, os.path.join(shared_folder(spark), "touchline-stage", application))


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read any more, and the shuffle files of the plans
    that made them."""
    for df in staged:
        _delete(df.sparkSession, df._staged_at)
    if staged:
        drop_shuffles(staged[0].sparkSession)


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage on storage that outlives executors, and gives the planner true sizes. Whole
    texts that later steps leave lying take less disk with the ``codec`` zstd.
    """
    path = stage_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._staged_at = path
    return read
