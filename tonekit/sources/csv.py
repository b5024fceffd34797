"""Delimited files with an explicit dialect.

Texts hold the separator, the quote character and newlines, so both directions use the same
quote as escape (doubling), ``multiLine`` on read, no whitespace trimming on write, and
``emptyValue=''`` so an empty string is written as nothing rather than as two quotes.
Between our own stages Parquet is used; CSV is for exchange with other tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _dialect(sep: str, quote: str, header: bool) -> dict[str, str]:
    return {"sep": sep, "quote": quote, "escape": quote, "header": str(header).lower(),
            "encoding": "UTF-8"}


def read_corpus_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ";",
                    quote: str = "'", header: bool = True) -> DataFrame:
    """Read with a fixed schema (no inference pass over the data)."""
    return (spark.read.schema(schema).options(**_dialect(sep, quote, header))
            .option("multiLine", "true").option("mode", "FAILFAST").csv(path))


def write_corpus_csv(df: DataFrame, path: str, sep: str = ";", quote: str = "'",
                     header: bool = True, mode: str = "overwrite") -> None:
    """One file per partition, no index column."""
    (df.write.mode(mode).options(**_dialect(sep, quote, header))
       .option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
       .option("ignoreTrailingWhiteSpace", "false").csv(path))
