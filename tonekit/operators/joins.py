"""Left joins of the corpus build and the sentence table.

Base dimension tables are broadcast only behind a bounded check of rows and bytes (``broadcast_if_small``,
cheap on a stored table); above the bound the join stays a shuffle join. Small *derived* tables
(aggregates) are not checked this way, since the check would run their whole lineage once more:
AQE broadcasts them from the measured size of the finished stage.
Left-join multiplicity is kept: a key repeated on the right multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, MapType, StringType, StructType

from tonekit.operators.stats import distinct_per_group

# Bytes (uncompressed, as measured) and rows under which a table may be broadcast.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
BROADCAST_MAX_ROWS = 1_000_000


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: lengths of strings and binaries, 8 or 16 for fixed types, JSON length of nested ones."""
    sizes = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, StringType | BinaryType):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(kind, ArrayType | MapType | StructType):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))), F.lit(0)))
        else:
            sizes.append(F.lit(16 if isinstance(kind, DecimalType) else 8))
    return reduce(lambda a, b: a + b, sizes, F.lit(16))


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of ``max_bytes`` together; reads at most ``max_rows + 1`` rows."""
    found = df.select(_row_bytes(df).cast("long").alias("b")).limit(max_rows + 1).agg(F.count("b").alias("n"), F.sum("b").alias("b")).first()
    return found["n"] <= max_rows and (found["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``F.broadcast(df)`` when its rows and bytes are proven bounded, else ``df`` unchanged."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def attach_meta(sentences: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentence rows left-joined with their document's other columns (text dropped).

    ``sentences`` carries the key as ``id``. The document table is as large as the corpus, so this
    is a shuffle join on the id; ``plans.sentiment`` avoids it by carrying metadata through the explode.
    """
    meta = docs.drop(text_col).withColumnRenamed(id_col, "id")
    return sentences.join(meta, "id", "left")


def distinct_count_join(df: DataFrame, key: str, col: str, exclude_col: str, exclude_text: str,
                        out: str = "n_distinct") -> DataFrame:
    """J3 + A2 + F3: distinct ``col`` per ``key`` among rows whose ``exclude_col`` does not contain
    ``exclude_text``, left-joined back onto every row of ``df`` (before any later recode)."""
    kept = df.where(~F.col(exclude_col).contains(exclude_text))
    counts = distinct_per_group(kept, key, col, out)
    return df.join(counts, key, "left")


def enrich(docs: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join with a dimension table, broadcast when its size is proven small."""
    return docs.join(broadcast_if_small(dim), on, "left")
