"""Session construction and a few cluster-safe helpers shared by plans, tests and the bench."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library relies on. On a cluster they are defaults only:
# anything already set by the cluster (spark-defaults, --conf) wins, see build_session.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files of materialized tables are removed once the table is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet splits of 128 MB keep per-task input bounded whatever the file sizes are.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, app_name: str = "tonekit",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a SparkSession with the library defaults.

    ``master`` and ``shuffle_partitions`` are meant for local runs and tests; on a cluster leave
    them unset so the submitter's settings apply (AQE then coalesces shuffle partitions).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("TONEKIT_DRIVER_MEMORY", "16g"))
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set ``fallback`` only when none is configured.

    ``fallback`` is for tests and local runs. On a cluster the checkpoint folder must be the shared
    one the cluster names, never a machine-local temporary folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    spark.sparkContext.setCheckpointDir(target)
    return target


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several later jobs reuse.

    With a checkpoint folder configured the table is written there (reliable ``checkpoint``, so
    a lost executor does not force recomputation from the raw corpus). Without one the table is
    persisted to memory and disk; a lost block is then recomputed from its lineage.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local session may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="tonekit-stored-")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    What is derived from it afterwards - also by several branches of one plan - sees the same rows,
    with the partition numbers and positions that were written. Parquet by Spark's committer, so
    it survives lost executors. Without a shared folder only a local session may go on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tonekit-stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
