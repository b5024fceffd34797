"""Numeric expressions with engine-independent results (same IEEE operations in any SQL engine)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def np_round(c: ColumnOrName, digits: int) -> Column:
    """Round half to even on the binary value scaled by 10**digits (numpy ``round``).

    Spark's ``round`` is half-up on the decimal text, so 0.25 -> 0.3 where numpy gives 0.2.
    Adding 0.0 turns -0.0 into 0.0.
    """
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """floor(x * 10**d + 0.5) / 10**d: the rounding used for stored scores."""
    scale = float(10 ** digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def exact_mean(c: ColumnOrName, scale: int = 4) -> Column:
    """Mean of values stored with ``scale`` decimals: exact decimal sum, one final division.

    The result does not depend on summation order (a double sum does, in the last bits).
    """
    x = _col(c)
    total = F.sum(x.cast(f"decimal(38,{scale})")).cast("double")
    return F.try_divide(total, F.count(x).cast("double"))


def ratio(num: ColumnOrName, den: ColumnOrName, scale: float = 1.0) -> Column:
    """P10: num / den * scale, null instead of an error when den is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double")) * F.lit(scale)


# Abramowitz & Stegun 7.1.26 rational approximation of erfc on x >= 0 (|error of erf| <= 1.5e-7).
# --- fixed values ---
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# --- end of fixed values ---


def erfc_pos(x: ColumnOrName) -> Column:
    """erfc(x) for x >= 0 as a column expression."""
    x = _col(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    a1, a2, a3, a4, a5 = (F.lit(v) for v in AS_A)
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    return poly * F.exp(-(x * x))


def normal_sf(z: ColumnOrName) -> Column:
    """P(Z > z) for a standard normal Z."""
    z = _col(z)
    half = F.lit(0.5) * erfc_pos(F.abs(z) / F.lit(math.sqrt(2.0)))
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)
