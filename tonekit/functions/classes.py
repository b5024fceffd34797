"""Class labels and agreement flags (B1-B3, P6) as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonekit.functions.patterns import CLASS_LABELS

ColumnOrName = Column | str

# Bin edges [min, upper of negative, upper of neutral, max], right-closed, lowest edge included.
EDGES_CONTINUOUS = (-1.0, -0.00001, 0.00001, 1.0)   # compound and polarity scores
EDGES_ORDINAL = (-10.0, 1.99, 2.01, 10.0)            # ordinal 0..4


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polarity_class(c: ColumnOrName, edges: Sequence[float] = EDGES_CONTINUOUS,
                   labels: Sequence[str] = CLASS_LABELS) -> Column:
    """B1: right-closed bins, lowest edge included; values outside [min, max] and nulls give null.

    ``Bucketizer`` is left-closed, hence the explicit ``when`` chain.
    """
    x = _col(c)
    lo, b1, b2, hi = (F.lit(float(e)) for e in edges)
    return (F.when((x >= lo) & (x <= b1), F.lit(labels[0]))
             .when((x > b1) & (x <= b2), F.lit(labels[1]))
             .when((x > b2) & (x <= hi), F.lit(labels[2])))


def label_if(pred: Column, yes: str, no: str) -> Column:
    """Two-way label; a null predicate takes the ``no`` branch."""
    return F.when(pred, F.lit(yes)).otherwise(F.lit(no))


def agreement(a: ColumnOrName, b: ColumnOrName) -> Column:
    """B2: ``agreement`` when both classes are equal; any null gives ``disagreement``."""
    return label_if(_col(a) == _col(b), "agreement", "disagreement")


def disagreement_type(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``one_neutral`` when either score is exactly 0, else ``other``."""
    return label_if((_col(a) == 0) | (_col(b) == 0), "one_neutral", "other")
