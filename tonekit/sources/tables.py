"""Input tables: Parquet with column pruning and filter pushdown left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``<base_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, base_dir: str) -> DataFrame:
    """S3: stored raw pages ``(page_id, url, html)``."""
    return read_table(spark, base_dir, "pages").select("page_id", "url", "html")
