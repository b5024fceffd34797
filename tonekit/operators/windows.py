"""Window operators (W1-W7) and sorts (O1-O3).

No operator here gathers a whole group into one task: per-document progress uses the contiguous
sentence rank and a count taken before the explode, the rolling mean has a window per piece of a
document, top-n runs in two salted rounds, and global orderings (panel numbers,
positions) range-partition, number rows inside each partition and add per-partition offsets
from a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonekit.functions.numeric import ratio
from tonekit.session import stored

ColumnOrName = Column | str
PIECE = 4096  # ranks of a document that one window may sort


def speech_progress(df: DataFrame, id_col: str = "id", order_col: str = "rank_sentence",
                    total_col: str | None = "n_sentences") -> DataFrame:
    """``cumcount`` (1-based position in the document) and ``percentage`` = cumcount / count.

    With ``total_col`` the frame must be as ``explode_sentences`` made it: its rank has no gaps and the
    total was counted before the explode, so nothing is shuffled. Pass ``total_col=None`` for a
    frame that was filtered since: the rows that are there are numbered, by pieces of
    ``PIECE`` ranks with the counts of earlier pieces added, so a long document spreads over tasks.
    """
    if total_col and total_col in df.columns:
        cum = (F.col(order_col) + 1).cast("int")
        return df.withColumn("cumcount", cum).withColumn("percentage", ratio(cum, F.col(total_col)))
    rows = df.withColumn("_piece", F.floor(F.col(order_col) / PIECE))
    counts = rows.groupBy(id_col, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(id_col).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(F.col(id_col).alias("_id"), F.col("_piece").alias("_p"),
                           (F.sum("_n").over(upto) - F.col("_n")).alias("_off"),
                           F.sum("_n").over(Window.partitionBy(id_col)).alias("_total"))
    nth = F.row_number().over(Window.partitionBy(id_col, "_piece").orderBy(order_col))
    rows = rows.withColumn("_nth", nth).join(
        counts, F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_piece").eqNullSafe(F.col("_p")))
    cum = (F.col("_off") + F.col("_nth")).cast("int")
    return (rows.withColumn("cumcount", cum).withColumn("percentage", ratio(F.col("cumcount"), F.col("_total")))
                .drop("_piece", "_nth", "_id", "_p", "_off", "_total"))


def rolling_mean(df: DataFrame, col: str, id_col: str = "id", order_col: str = "rank_sentence",
                 window: int = 5, out: str | None = None) -> DataFrame:
    """Trailing mean over the ``window`` ranks up to a row's own; null until the window is full, at gaps in
    the rank, or if any value is null.

    A document's ranks are cut into pieces of ``PIECE``, and the last ``window - 1`` rows of a piece are copied into the next
    one: one window per piece, so a very long document spreads over tasks, for one shuffle of
    n * (1 + (window - 1) / PIECE) rows. Every column of ``df`` rides through the shuffle: project first.
    """
    out = out or f"{col}_ma{window}"
    size = max(PIECE, 2 * window)
    piece = F.floor(F.col(order_col) / size)
    near_end = F.pmod(F.col(order_col), F.lit(size)) >= size - (window - 1)
    pieces = F.when(near_end, F.array(piece, piece + 1)).otherwise(F.array(piece))
    rows = df.select("*", F.explode(pieces).alias("_piece"))
    over = Window.partitionBy(id_col, "_piece").orderBy(order_col).rangeBetween(-(window - 1), 0)
    full = F.count(col).over(over) == window
    rows = rows.withColumn(out, F.when(full, F.sum(col).over(over) / F.lit(float(window))))
    return rows.where((F.col("_piece") == piece) | F.col("_piece").isNull()).select(*df.columns, out)


def top_n_per_group(df: DataFrame, group_col: str, order_col: str, n: int,
                    descending: bool = True, salt_buckets: int | None = None) -> DataFrame:
    """The first ``n`` rows per group by ``order_col`` (a top-k report; ties by order value).

    Two rounds so that a hot group is never sorted in one task: the top ``n`` of each
    (group, salt) slice first, then the top ``n`` of the at most ``n * salt_buckets`` survivors. By default there are as many
    slices as the cluster has shuffle partitions.
    Exact, because the overall top ``n`` is the top ``n`` of the slices' top ``n`` sets.
    """
    if salt_buckets is None:
        salt_buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group_col, "_salt").orderBy(order)
    cand = salted.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    w2 = Window.partitionBy(group_col).orderBy(order)
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)


def global_row_number(df: DataFrame, order_cols: Sequence[ColumnOrName], out: str = "row_number") -> DataFrame:
    """1-based row number over a total order, computed without a single-partition window.

    Range partitioning by the order keys, local numbering with ``monotonically_increasing_id``
    after a sort within each partition, plus the row count of all earlier partitions (a table
    with one row per partition). The numbered rows are written once (``stored``): the counts and
    the rows read the same partition numbers, which are data by then, so no row can be lost or
    numbered twice whatever the optimizer does with either branch.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = stored(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                      .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    # One row per partition: a structural size bound, so the broadcast hint is safe.
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + local + F.lit(1))
                  .drop("_mid", "_pid", "_off"))


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str = "cum",
               group_col: str | None = None) -> DataFrame:
    """Running sum of ``value_col`` in ``order_col`` order (per ``group_col``), rows included.

    ``order_col`` must be unique (within the group). Range partitioning by (group, order) splits
    even one huge group over many tasks; the rows are written once with the number of their range
    (``stored``), each range sums its own rows in order, and the totals of earlier ranges (a table
    of at most ranges x groups rows) are added as offsets.
    """
    keys = ([group_col] if group_col else []) + [order_col]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    part_keys = ["_pid"] + ([group_col] if group_col else [])
    local_w = Window.partitionBy(*part_keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value_col).over(local_w))
    totals = ranged.groupBy(*part_keys).agg(F.sum(value_col).alias("_t"))
    before = Window.partitionBy(*([group_col] if group_col else [])).orderBy("_pid")
    offsets = totals.select("_pid", *([F.col(group_col).alias("_g")] if group_col else []),
                            (F.sum("_t").over(before) - F.col("_t")).alias("_off")).withColumnRenamed("_pid", "_p")
    same = F.col("_pid") == F.col("_p")
    if group_col:  # null is a group like any other
        same = same & F.col(group_col).eqNullSafe(F.col("_g"))
    joined = local.join(offsets, same)
    return joined.withColumn(out, F.col("_local") + F.col("_off")).drop("_pid", "_local", "_off", "_p", "_g")


def panel_index(df: DataFrame, id_col: str, order_cols: Sequence[str], ncol: int = 3) -> DataFrame:
    """Panel number by order of first appearance, plus grid row and column (``ncol`` wide).

    ``df`` holds one row per id (distinct ids); ``order_cols`` must end with the id for a total order.
    """
    numbered = global_row_number(df, order_cols, "_rn")
    panel = F.col("_rn") - F.lit(1)
    return (numbered.withColumn("panel", panel)
                    .withColumn("panel_row", F.floor(panel / F.lit(ncol)).cast("int"))
                    .withColumn("panel_col", F.pmod(panel, F.lit(ncol)).cast("int"))
                    .drop("_rn"))


def sort_by(df: DataFrame, cols: Sequence[ColumnOrName]) -> DataFrame:
    """O1-O3: global sort (range-partitioned by Spark)."""
    return df.orderBy(*cols)
