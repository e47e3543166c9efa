"""Session settings, durable cut points and scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tablewright", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; pass `master` for local runs only."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # models are fitted side by side
        "spark.scheduler.mode": "FAIR",
        # expressions over many columns are built much faster without a call site for each
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by spark.checkpoint.dir, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, under the shared folder on a cluster."""
    root = shared_folder(spark)
    if root is None:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tablewright-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete an intermediate folder when it ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read on from there.

    What is read back no longer depends on any executor, so values that must not change when
    a task is retried (row ids, partition numbers) are safe to use after this point. The copy is
    deleted when the driver ends.
    """
    path = scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a table that arrives in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
