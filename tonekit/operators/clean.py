"""Projections, recodes, filters, unions and dedup.

All are narrow column expressions except ``dedupe`` and ``distinct_rows`` (one shuffle on the
dedup keys, with map-side pre-aggregation) and ``drop_by_position`` (a distributed global rank).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonekit.functions.text import clean_strings, replace_names, strip_brackets


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep and order columns."""
    return df.select(*cols)


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(dict(mapping))


# Column-name patterns removed by clean_names: bracketed marks, then a ``.suffix`` (``Party.1``).
NAME_PATTERNS = (r"\[(.*)\]", r"\.(.*)")


def clean_names(df: DataFrame, patterns: Iterable[str] = NAME_PATTERNS) -> DataFrame:
    """Regex clean-up of column *names* (driver-side metadata only; no data moves)."""
    def fix(name: str) -> str:
        for p in patterns:
            name = re.sub(p, "", name)
        return name
    return df.toDF(*[fix(c) for c in df.columns])


def recode(df: DataFrame, col: str, rules: Sequence[tuple[Column, object]]) -> DataFrame:
    """P5: overwrite ``col`` with the value of the first rule whose predicate holds."""
    expr = None
    for pred, value in rules:
        expr = F.when(pred, F.lit(value)) if expr is None else expr.when(pred, F.lit(value))
    return df.withColumn(col, expr.otherwise(F.col(col)) if expr is not None else F.col(col))


def with_label(df: DataFrame, name: str, value: object) -> DataFrame:
    """Constant label column."""
    return df.withColumn(name, F.lit(value))


def fill(df: DataFrame, col: str, value: object) -> DataFrame:
    """Fill nulls of one column."""
    return df.fillna({col: value})


def strip_all_brackets(df: DataFrame) -> DataFrame:
    """T1 over every string column."""
    return clean_strings(df, strip_brackets)


def normalise_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """T2 over every string column."""
    return clean_strings(df, lambda c: replace_names(c, mapping))


# ---- filters -------------------------------------------------------------------------------

def where_contains(df: DataFrame, col: str, s: str) -> DataFrame:
    """F1"""
    return df.where(F.col(col).contains(s))


def where_rlike(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """F2"""
    return df.where(F.col(col).rlike(pattern))


def where_not_contains(df: DataFrame, col: str, s: str) -> DataFrame:
    """rows whose value does not contain ``s`` (null values are dropped, as by a pandas mask)."""
    return df.where(~F.col(col).contains(s))


def where_gt(df: DataFrame, col: str, value) -> DataFrame:
    """F4"""
    return df.where(F.col(col) > F.lit(value))


def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    """F5"""
    return df.where(F.col(col) == F.lit(value))


def drop_if_any_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop rows where any listed column equals 0; a null is not 0, so it is kept."""
    keep = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != 0, F.lit(True)) for c in cols])
    return df.where(keep)


def drop_by_position(df: DataFrame, order_cols: Sequence[str], positions: Sequence[int],
                     drop_last: bool = False) -> DataFrame:
    """F8: drop rows by 0-based position in ``order_cols`` order (and optionally the last row).

    No ranks: the keys at the positions are among the first ``max(positions) + 1`` in order (a bounded
    top-k), the last key is a maximum, and rows with these keys are left out by an anti-join.
    ``order_cols`` must be a total order (null first, as Spark sorts); positions beyond the table
    drop nothing.
    """
    keys = list(order_cols)
    gone = []
    if positions:
        first = df.select(*keys).orderBy(*keys).limit(max(positions) + 1)  # bounded by the caller's positions
        number = F.row_number().over(Window.orderBy(*keys)) - 1
        gone.append(first.withColumn("_pos", number).where(F.col("_pos").isin(list(positions))).select(*keys))
    if drop_last:
        gone.append(df.select(*keys).orderBy(*[F.col(k).desc() for k in keys]).limit(1))
    if not gone:
        return df
    left_out = reduce(DataFrame.union, gone).toDF(*[f"_k{i}" for i in range(len(keys))])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(left_out), same, "left_anti")


# ---- unions and dedup ----------------------------------------------------------------------

def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def stack(dfs: Sequence[DataFrame], labels: Sequence[str], label_col: str = "corpus") -> DataFrame:
    """Union of several tables, each tagged with its label."""
    return union_all([with_label(d, label_col, lab) for d, lab in zip(dfs, labels)])


def distinct_rows(df: DataFrame) -> DataFrame:
    """U3"""
    return df.distinct()


def dedupe(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """U4: one row per ``keys``, the one with the smallest ``order_col`` (null keys form a group).

    Written as ``min_by`` over a struct of all other columns: a hash aggregate with map-side partial
    aggregation, so a hot key (one text repeated in a third of the rows) is pre-reduced on every
    mapper and only one row per key and mapper crosses the shuffle. A window with row_number would
    instead sort every copy of the hot key into a single task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def n_groups(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct values."""
    return df.agg(F.countDistinct(col).alias("n_groups"))
