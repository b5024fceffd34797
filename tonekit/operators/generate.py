"""Explode arrays and maps into rows without evaluating the collection twice.

For a plain ``explode``/``posexplode`` Catalyst infers ``size(c) > 0 AND c IS NOT NULL`` on the
input and pushes that filter below the projection that computes ``c``, substituting the whole
expression: an expensive array (sentence split, tokens, regex matches) is then built twice per
row. The ``_outer`` generators get no inferred filter; the one row they emit for an empty or
null collection (null position) is dropped right after, so the rows are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, collection: Column, names: Sequence[str], keep: Sequence[Column | str] = (),
                 with_pos: bool = False) -> DataFrame:
    """Rows of ``keep`` plus the exploded ``collection``.

    ``names``: output names (value for an array, key and value for a map), preceded by the
    position name when ``with_pos``.
    """
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(collection).alias(*names))
        return out.where(F.col(names[0]).isNotNull())
    pos = "_pos"
    out = df.select(*keep, F.posexplode_outer(collection).alias(pos, *names))
    return out.where(F.col(pos).isNotNull()).drop(pos)
