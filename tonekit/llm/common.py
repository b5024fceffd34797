"""Helpers shared by the operators: the cluster's shared folder, staged tables, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that separates words.
SPACES = " \t\n\x0b\f\r"

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own when the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tonekit-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver program ends."""
    path = f"{shared_folder(spark)}/tonekit-{uuid.uuid4().hex}/{name}"
    if not _SCRATCH:
        atexit.register(_clear)
    _SCRATCH.append((spark, path.rsplit("/", 1)[0]))
    return path


def _clear() -> None:
    for spark, path in _SCRATCH:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: its folder is the cluster's to clear
            return


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again, and
    several readers share one pass. Written by Spark's committer, so retried tasks leave no rest.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text as long (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
