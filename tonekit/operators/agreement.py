"""Agreement between the three scorers (B1-B3 applied, A11-A16, A20).

Every table here is an aggregate with a bounded number of groups (3 classes, 21 rounded values
per score, 2 flags); the per-row work is column expressions on the scored sentence table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonekit.functions.classes import (
    EDGES_CONTINUOUS, EDGES_ORDINAL, agreement, disagreement_type, polarity_class,
)
from tonekit.functions.numeric import np_round
from tonekit.functions.patterns import CLASS_LABELS
from tonekit.operators.clean import drop_if_any_zero

SCORERS = ("compound", "polarity", "ordinal")
EDGES = {"compound": EDGES_CONTINUOUS, "polarity": EDGES_CONTINUOUS, "ordinal": EDGES_ORDINAL}
PAIRS = tuple(combinations(SCORERS, 2))   # (compound, polarity), (compound, ordinal), (polarity, ordinal)


def classify(df: DataFrame, scorers: Sequence[str] = SCORERS) -> DataFrame:
    """B1 for each scorer: ``cat_<scorer>`` in negative / neutral / positive."""
    return df.withColumns({f"cat_{s}": polarity_class(F.col(s), EDGES[s]) for s in scorers})


def agreement_flags(df: DataFrame) -> DataFrame:
    """B1 + B2: classes and one ``flag_<a>_<b>`` per scorer pair."""
    out = classify(df)
    return out.withColumns({f"flag_{a}_{b}": agreement(f"cat_{a}", f"cat_{b}") for a, b in PAIRS})


def agreement_pct(df: DataFrame) -> DataFrame:
    """Percent of all rows in agreement / disagreement, per scorer pair.

    The denominator is every row, including rows with a null class; a flag that never occurs
    has no row.
    """
    flags = agreement_flags(df)
    pairs = [f"{a}_{b}" for a, b in PAIRS]
    long = flags.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("pair"), F.col(f"flag_{p}").alias("flag")) for p in pairs])).alias("f"))
    counts = long.groupBy(F.col("f.pair").alias("pair"), F.col("f.flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("pair"))
    return counts.select("pair", "flag", "n", (F.col("n") * F.lit(100.0) / total).alias("pct"))


def crosstab_rounded(df: DataFrame, a: str = "compound", b: str = "polarity", digits: int = 1) -> DataFrame:
    """Rows with both scores non-zero, both rounded (numpy rule); share of each b value per a value.

    Long format ``(a_round, b_round, n, share)``; only cells that occur are present.
    """
    nz = drop_if_any_zero(df.select(a, b), [a, b]).dropna()
    cells = nz.groupBy(np_round(F.col(a), digits).alias(f"{a}_round"),
                       np_round(F.col(b), digits).alias(f"{b}_round")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(f"{a}_round")))


def crosstab_classes(df: DataFrame, row: str, col: str, labels: Sequence[str] = CLASS_LABELS,
                     weight: str | None = None) -> DataFrame:
    """A13 + A20: row-normalised crosstab of two class columns, one column per label.

    Output ``(<row>, <label>..., pct_<label>...)``: shares, and shares x 100 rounded half-even.
    Rows or columns with a null class are left out (pandas ``crosstab``). ``weight`` names a count
    column when ``df`` is already aggregated (one row per class combination).
    """
    base = df.select(row, col, *([weight] if weight else [])).dropna(subset=[row, col])
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    piv = base.groupBy(row).pivot(col, list(labels)).agg(measure).fillna(0, subset=list(labels))
    total = sum((F.col(lab) for lab in labels), F.lit(0))
    shares = {lab: F.col(lab) / total for lab in labels}
    out = piv.select(row, *[shares[lab].alias(lab) for lab in labels])
    return out.withColumns({f"pct_{lab}": F.rint(F.col(lab) * 100) for lab in labels})


def class_cells(df: DataFrame) -> DataFrame:
    """Counts per (ordinal, compound, polarity) class combination: 27 rows at most, read once."""
    from tonekit.session import materialize
    cells = classify(df).groupBy("cat_ordinal", "cat_compound", "cat_polarity").agg(F.count(F.lit(1)).alias("n"))
    return materialize(cells)


def class_crosstabs(df: DataFrame) -> dict[str, DataFrame]:
    """A21 crosstabs: rounded compound x polarity, ordinal x compound classes, ordinal x polarity classes."""
    cells = class_cells(df)
    return {
        "crosstab_compound_polarity": crosstab_rounded(df, "compound", "polarity"),
        "crosstab_compound_ordinal": crosstab_classes(cells, "cat_ordinal", "cat_compound", weight="n"),
        "crosstab_polarity_ordinal": crosstab_classes(cells, "cat_ordinal", "cat_polarity", weight="n"),
    }


def disagreement_types(df: DataFrame, a: str = "compound", b: str = "polarity") -> DataFrame:
    """B3 + A14: share of ``one_neutral`` / ``other`` within agreement and within disagreement (all rows)."""
    flagged = df.select(
        agreement(polarity_class(F.col(a)), polarity_class(F.col(b))).alias("disagreement"),
        disagreement_type(a, b).alias("type_disagreement"))
    return crosstab_classes(flagged, "disagreement", "type_disagreement", ["one_neutral", "other"]) \
        .drop("pct_one_neutral", "pct_other")


def pearson(a: str, b: str):
    """Guarded Pearson r: null for a constant column instead of a divide-by-zero error."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def corr_matrix(df: DataFrame, cols: Sequence[str] = ("compound", "polarity")) -> DataFrame:
    """Correlation matrix on rows where no column is 0, after dropping rows with a null."""
    nz = drop_if_any_zero(df.select(*cols), cols).dropna()
    cells = [F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"),
                      (F.lit(1.0) if x == y else pearson(x, y)).alias("r"))
             for x in cols for y in cols]
    return nz.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("c")).select("c.*")


def corr_info(df: DataFrame, a: str = "compound", b: str = "polarity") -> DataFrame:
    """A15 + A22: one row: r(a, b) on non-zero pairs and the share of disagreements with a zero score.

    One aggregation pass: the correlation terms only see rows where both scores are non-null and
    non-zero; the share is looked up by label (disagreement x one_neutral), null when no row disagrees.
    """
    x, y = F.col(a), F.col(b)
    pair = x.isNotNull() & y.isNotNull() & (x != 0) & (y != 0)
    xa, ya = F.when(pair, x), F.when(pair, y)
    dis = agreement(polarity_class(x), polarity_class(y)) == F.lit("disagreement")
    one_neutral = disagreement_type(x, y) == F.lit("one_neutral")
    return df.agg(
        F.try_divide(F.covar_samp(xa, ya), F.stddev_samp(xa) * F.stddev_samp(ya)).alias("r"),
        F.try_divide(F.count(F.when(dis & one_neutral, 1)).cast("double"),
                     F.count(F.when(dis, 1)).cast("double")).alias("share_one_neutral"),
    )
