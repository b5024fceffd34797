"""Aggregations and statistics.

Pattern used throughout: reduce rows to a bounded table first (counts per group, per distinct
score value, per bin), with map-side partial aggregation, and run any window or cross-row step on
that bounded table only. Scores are rounded (compound to 4 digits), so the number of distinct
values per group is bounded no matter how many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonekit.functions.numeric import normal_sf, np_round
from tonekit.functions.text import let


def _not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def value_counts(df: DataFrame, col: str, groups: Sequence[str] = (), sums: Sequence[str] = (),
                 scale: int = 4, bound: bool = True) -> DataFrame:
    """The bounded table every distribution statistic starts from: ``(*groups, v, c, s_<sum>...)``.

    One aggregation (map-side combine) over the expensive input: count per distinct value of
    ``col`` and exact decimal sums of ``sums`` (values stored with ``scale`` decimals). Scores are
    rounded, so the table has at most (groups x distinct score values) rows whatever the corpus
    size. With ``bound`` it is materialized (checkpoint folder, else memory and disk), so the
    several statistics derived from it do not re-run the scoring.
    """
    from tonekit.session import materialize
    base = _not_null(df, [*groups, col])
    aggs = [F.count(F.lit(1)).alias("c")] + [
        F.sum(F.col(x).cast(f"decimal(38,{scale})")).alias(f"s_{x}") for x in sums]
    out = base.groupBy(*groups, F.col(col).alias("v")).agg(*aggs)
    return materialize(out) if bound else out


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1: rows per group; null keys are left out (pandas ``groupby``)."""
    return _not_null(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def distinct_per_group(df: DataFrame, key: str, col: str, out: str = "n_distinct") -> DataFrame:
    """A2: exact distinct count per group."""
    return _not_null(df, [key]).groupBy(key).agg(F.countDistinct(col).alias(out))


def summary_by(df: DataFrame, id_col: str, value: str, first_col: str, order_col: str,
               date_col: str | None = None) -> DataFrame:
    """A3 + A6: mean, sample std, first ``first_col`` by ``order_col``, earliest date; mean -/+ std."""
    aggs = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min_by(first_col, order_col).alias(first_col)]
    if date_col:
        aggs.append(F.min(date_col).alias(date_col))
    out = _not_null(df, [id_col]).groupBy(id_col).agg(*aggs)
    return band(out, "mean", "std")


def band(df: DataFrame, mean_col: str, std_col: str) -> DataFrame:
    """``lower`` = mean - std, ``upper`` = mean + std (null when std is null)."""
    return (df.withColumn("lower", F.col(mean_col) - F.col(std_col))
              .withColumn("upper", F.col(mean_col) + F.col(std_col)))


def mean_over_time(df: DataFrame, id_col: str, value: str, first_col: str, order_col: str,
                   date_col: str) -> DataFrame:
    """A4 + O2: mean per id with first ``first_col`` and the year of the earliest date, sorted by year."""
    out = (_not_null(df, [id_col]).groupBy(id_col)
           .agg(F.avg(value).alias("mean"), F.min_by(first_col, order_col).alias(first_col),
                F.year(F.min(date_col)).alias("year")))
    return out.orderBy("year", id_col)


def scorer_means(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """A5: mean of each score per id."""
    return _not_null(df, [id_col]).groupBy(id_col).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def value_share(df: DataFrame, col: str, groups: Sequence[str] = ()) -> DataFrame:
    """A7 + O3: count per value (nulls left out) and percent of the group's total, sorted by value."""
    counts = _not_null(df, [col, *groups]).groupBy(*groups, col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*groups)) if groups else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total).orderBy(*groups, col)


def group_share(df: DataFrame, value: str, group: str) -> DataFrame:
    """A1 + A8 + J5: count per (value, group), natural left join with group sizes, ``perc`` = n / size.

    One aggregation: counts per (value, group) keep the null value as a group so that the group
    sizes (all rows of the group) are sums of the same table.
    """
    counts = _not_null(df, [group]).groupBy(value, group).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("groupsize"))
    counts = counts.where(F.col(value).isNotNull())
    shared = [c for c in counts.columns if c in sizes.columns]
    return counts.join(sizes, shared, "left").withColumn("perc", F.col("n") / F.col("groupsize"))


def histogram_pct(df: DataFrame, col: str, group: str, bins: int = 20, digits: int = 4) -> DataFrame:
    """Equal-width histogram per group in percent, empty bins kept (``bins`` rows per group).

    Values are rounded to ``digits`` first. Bin i covers [lo_i, hi_i); the last bin is closed.
    When a group's min equals its max, the range is widened to [v - 0.5, v + 0.5] (numpy rule).
    Computed from the value-count table: the input is read once.
    """
    vals = _not_null(df, [col, group]).select(group, np_round(F.col(col), digits).alias("x"))
    vc = value_counts(vals, "x", [group])
    rng = vc.groupBy(group).agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.sum("c").alias("total"))
    rng = (rng.withColumn("lo", F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")))
              .withColumn("hi", F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))))
    n = F.lit(float(bins))
    step = (F.col("hi") - F.col("lo")) / n

    def edge(k):
        return F.when(k >= bins, F.col("hi")).otherwise(F.col("lo") + k * step)

    # the quotient may miss a bin by rounding: the edges themselves decide, as in numpy
    near = F.least(F.floor((F.col("v") - F.col("lo")) * n / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    idx = (F.when(F.col("v") < edge(near), near - 1)
            .when((F.col("v") >= edge(near + 1)) & (near < bins - 1), near + 1).otherwise(near))
    counts = (vc.join(rng.select(group, "lo", "hi"), group)
                .groupBy(group, idx.cast("int").alias("bin")).agg(F.sum("c").alias("n")))
    grid = rng.select(group, "lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / n
    return (grid.join(counts, [group, "bin"], "left")
                .select(group, "bin",
                        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
                        (F.coalesce(F.col("n"), F.lit(0)) * F.lit(100.0) / F.col("total")).alias("pct")))


def kde(df: DataFrame, col: str, group: str, points: int = 100, cut: float = 3.0) -> DataFrame:
    """A10: Gaussian kernel density per group on ``points`` grid points, Scott bandwidth.

    h = std * n^(-1/5); grid from min - cut*h to max + cut*h. Rows are counted per value first (map-side combine), and those
    counts give n, mean, std and range. A fast Gauss transform follows: values are binned at h / ``FINE``, a bin
    keeps its first ``MOMENTS`` moments about its middle, and a grid point adds up the Hermite expansions of the bins within
    nine bandwidths. The truncation is below rounding, and the sum has at most ``points`` * 18 * ``FINE`` terms a
    group, however many distinct values there are.
    """
    vc = value_counts(df, col, [group])
    first = vc.groupBy(group).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"),
                                  F.min("v").alias("mn"), F.max("v").alias("mx"))
    dev = vc.join(first, group).groupBy(group, "n", "mn", "mx").agg(
        F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("ss"))
    st = (dev.withColumn("sd", F.sqrt(F.try_divide(F.col("ss"), (F.col("n") - 1).cast("double"))))
             .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
             .where(F.col("h") > 0))
    step = (F.col("mx") - F.col("mn") + F.lit(2 * cut) * F.col("h")) / F.lit(float(points - 1))
    grid = st.select(group, "n", "h", "mn", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
                     (F.col("mn") - F.lit(cut) * F.col("h")).alias("start"), step.alias("step"))
    grid = grid.withColumn("x", F.col("start") + F.col("i") * F.col("step")).drop("start", "step")
    width = F.col("h") / F.lit(float(FINE))
    binned = vc.join(st.select(group, "h", "mn"), group).withColumn("bin", F.floor((F.col("v") - F.col("mn")) / width))
    off = (F.col("v") - F.col("mn")) / F.col("h") - (F.col("bin") + 0.5) / F.lit(float(FINE))
    binned = binned.select(group, "bin", F.col("c").cast("double").alias("m0"), off.alias("_t"))
    powers = [F.col("m0")]
    for _ in range(1, MOMENTS):
        powers.append(powers[-1] * F.col("_t"))
    bins = binned.groupBy(group, "bin").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    near, reach = F.floor((F.col("x") - F.col("mn")) / width), 9 * FINE
    wanted = grid.withColumn("bin", F.explode(F.sequence(near - reach, near + reach)))
    wanted = wanted.join(bins, [group, "bin"]).withColumn(
        "_u", (F.col("x") - F.col("mn")) / F.col("h") - (F.col("bin") + 0.5) / F.lit(float(FINE)))
    u, hermite, term = F.col("_u"), [F.lit(1.0), F.col("_u")], F.col("m0")
    for k in range(1, MOMENTS):
        term = term + F.col(f"m{k}") * hermite[k] * F.lit(1.0 / math.factorial(k))
        hermite.append(u * hermite[k] - F.lit(float(k)) * hermite[k - 1])
    sums = wanted.groupBy(group, "i").agg(F.sum(term * F.exp(F.lit(-0.5) * u * u)).alias("k"))
    dens = grid.join(sums, [group, "i"], "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return dens.select(group, "i", "x", (F.col("k") / norm).alias("density"))


def order_key(value: Column) -> Column:
    """A long that sorts as the double does (-0.0 as 0.0): its bits, those of negative numbers turned round."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return let(bits, lambda b: F.when(b >= 0, b).otherwise(b.bitwiseXOR(F.lit((1 << 63) - 1))))


def key_value(key: Column) -> Column:
    """The double of an ``order_key``."""
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


#: Bins of a bandwidth and moments of a bin: terms left out are below (1 / 16)^9 / 9!.
FINE, MOMENTS = 8, 9
STEP_BITS = 16


def order_statistics(df: DataFrame, group: str, col: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``group, n`` and the exact values at given ranks (1-based, from the group's size ``n``) of raw doubles.

    No table of distinct values and no sort of rows: (group, key) is stored once; four passes each count keys by the next
    16 bits inside the bucket that holds the rank, so a pass returns at most 65,536 counts a (group, rank). Nulls and
    NaN are left out; groups of any size spread over tasks, as counts are combined map-side.
    """
    from tonekit.session import materialize, stored
    rows = _not_null(df, [group, col]).where(~F.isnan(F.col(col).cast("double")))
    keys = stored(rows.select(F.col(group).alias("_g"), order_key(F.col(col)).alias("_key")))
    sizes = materialize(keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n")))
    wanted = ranks(F.col("n"))
    open_ = sizes.select("_g", F.inline(F.array(*[F.struct(F.lit(name).alias("_rank"), r.cast("long").alias("_left"))
                                                  for name, r in wanted.items()]))).withColumn("_head", F.lit(0).cast("long"))
    for shift in range(64 - STEP_BITS, -1, -STEP_BITS):
        head, part = F.shiftright("_key", shift + STEP_BITS), F.shiftright("_key", shift)
        if shift + STEP_BITS == 64:
            head = F.lit(0).cast("long")
        found = keys.select("_g", head.alias("_head"), part.alias("_part"))
        buckets = open_.select("_g", "_head").distinct()
        counts = found.join(buckets, ["_g", "_head"], "left_semi").groupBy("_g", "_head", "_part").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy("_g", "_head").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_c").over(upto))
        hit = open_.join(counts, ["_g", "_head"]).where((F.col("_left") <= F.col("_upto")) & (F.col("_left") > F.col("_upto") - F.col("_c")))
        open_ = materialize(hit.select("_g", "_rank", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"),
                                       F.col("_part").alias("_head")))
    values = open_.groupBy("_g").agg(*[F.max(F.when(F.col("_rank") == name, F.col("_head"))).alias(name) for name in wanted])
    values = values.select("_g", *[key_value(F.col(name)).alias(name) for name in wanted])
    return sizes.join(values, "_g").withColumnRenamed("_g", group)


def median_of_raw(df: DataFrame, group: str, col: str) -> DataFrame:
    """A17 on values that were not rounded: ``group, median, n``, exact."""
    both = order_statistics(df, group, col, lambda n: {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1})
    return both.select(group, ((F.col("_low") + F.col("_high")) / 2).alias("median"), "n")


def median_from_counts(vc: DataFrame, group: str) -> DataFrame:
    """Exact median per group from a value-count table ``(group, v, c)``."""
    from tonekit.operators.windows import prefix_sum
    sizes = vc.groupBy(group).agg(F.sum("c").alias("n"))
    cum = prefix_sum(vc.select(group, "v", "c"), "v", "c", "cum", group_col=group).join(sizes, group)
    lo_k = F.floor((F.col("n") + 1) / 2)          # 1-based position of the lower middle value
    hi_k = F.floor(F.col("n") / 2) + 1             # 1-based position of the upper middle value
    first = F.col("cum") - F.col("c") + 1
    cum = (cum.withColumn("is_lo", (first <= lo_k) & (F.col("cum") >= lo_k))
              .withColumn("is_hi", (first <= hi_k) & (F.col("cum") >= hi_k)))
    return (cum.groupBy(group)
               .agg(((F.max(F.when(F.col("is_lo"), F.col("v"))) + F.max(F.when(F.col("is_hi"), F.col("v")))) / 2)
                    .alias("median"),
                    F.first("n").alias("n")))


def median_by(df: DataFrame, group: str, col: str) -> DataFrame:
    """Exact median per group (mean of the two middle values for an even count).

    Counts per distinct value, then a running count per group over that table (distributed prefix
    sum): no group's rows are ever gathered into one task.
    """
    return median_from_counts(value_counts(df, col, [group]), group)


def mann_whitney(df: DataFrame, col: str, group: str, a, b) -> DataFrame:
    """Mann-Whitney U between rows with ``group == a`` and ``group == b``.

    Average ranks with ties come from counts per distinct value and a distributed running sum over
    the distinct values, never over rows. Returns one row:
    n1, n2, r1, u1, u2, u (= min), tie term sum(t^3 - t), z = (|u1 - mu| - 0.5) / sigma,
    p_two_sided, p_greater (alternative: a tends to be larger) and p_less: exact for small groups without ties
    (``EXACT_SMALLER``, ``EXACT_PAIRS``), else by the normal approximation with continuity correction and
    tie-corrected sigma; ``method`` says which.
    """
    from tonekit.operators.windows import prefix_sum
    vc = value_counts(df.where(F.col(group).isin(a, b)), col, [group])
    counts = (vc.groupBy("v")
                .agg(F.sum(F.when(F.col(group) == F.lit(a), F.col("c")).otherwise(0)).alias("na"),
                     F.sum("c").alias("t")))
    ranked = prefix_sum(counts, "v", "t", "cum")
    avg_rank = F.col("cum") - (F.col("t") - 1) / 2.0
    summary = ranked.agg(
        F.sum(F.col("na")).alias("n1"),
        (F.sum("t") - F.sum("na")).alias("n2"),
        F.sum(F.col("na") * avg_rank).alias("r1"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"),  # t^3 outgrows BIGINT
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties").cast("double") / (n * (n - 1))))
    out = summary.select("n1", "n2", "r1", u1.alias("u1"), (n1 * n2 - u1).alias("u2"),
                         F.col("ties").alias("ties"), mu.alias("mu"), sigma.alias("sigma"))
    out = out.withColumn("u", F.least("u1", "u2"))
    dev = F.col("u1") - F.col("mu")
    z_two = F.try_divide(F.abs(dev) - 0.5, F.col("sigma"))
    z_greater = F.try_divide(dev - 0.5, F.col("sigma"))
    z_less = F.try_divide(-dev - 0.5, F.col("sigma"))
    approximate = {"p_two_sided": F.least(F.lit(1.0), F.lit(2.0) * normal_sf(z_two)), "p_greater": normal_sf(z_greater),
                   "p_less": normal_sf(z_less)}
    out = out.withColumn("z", z_two).withColumns(approximate)
    small = (F.least("n1", "n2") >= 1) & (F.least("n1", "n2") <= EXACT_SMALLER) & (F.col("n1") * F.col("n2") <= EXACT_PAIRS) & (F.col("ties") == 0)
    counts = F.when(small, u_counts(F.least("n1", "n2").cast("int"), F.greatest("n1", "n2").cast("int")))
    out = out.withColumn("_counts", counts)
    total = F.aggregate("_counts", F.lit(0.0), lambda s, x: s + x)

    def at_least(u: Column) -> Column:
        tail = F.slice("_counts", (u + 1).cast("int"), F.size("_counts"))
        return F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / total

    exact = F.col("_counts").isNotNull()
    most = F.greatest("u1", "u2")
    return out.select("n1", "n2", "r1", "u1", "u2", "u", "ties", "z",
                      F.when(exact, F.least(F.lit(1.0), F.lit(2.0) * at_least(most))).otherwise(F.col("p_two_sided")).alias("p_two_sided"),
                      F.when(exact, at_least(F.col("u1"))).otherwise(F.col("p_greater")).alias("p_greater"),
                      F.when(exact, at_least(F.col("u2"))).otherwise(F.col("p_less")).alias("p_less"),
                      F.when(exact, F.lit("exact")).otherwise(F.lit("normal")).alias("method"))


#: Without ties, p values are exact if the smaller group has at most so many rows and there are at most so many pairs.
EXACT_SMALLER, EXACT_PAIRS = 8, 2000


def u_counts(m: Column, n: Column) -> Column:
    """How many of the orders of ``m`` and ``n`` different values have U = 0, 1, ..., m * n (doubles).

    The counting recurrence as a fold: with one value more, either it is of the smaller group, or it is not and
    adds one to U for each of the k that are. State k holds the counts for k values of the smaller group so far.
    """
    size = m * n + 1
    nothing = F.array_repeat(F.lit(0.0), size)
    start = F.transform(F.sequence(F.lit(0), m), lambda k: F.when(k == 0, F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1)))
                        .otherwise(nothing))

    def step(state: Column, i: Column) -> Column:
        def row(k: Column) -> Column:
            moved = F.when(i - k <= n, F.slice(F.concat(F.array_repeat(F.lit(0.0), k), F.get(state, k)), 1, size)).otherwise(nothing)
            taken = F.when(k > 0, F.get(state, F.greatest(k - 1, F.lit(0)))).otherwise(nothing)
            return F.zip_with(moved, taken, lambda x, y: x + y)
        return F.transform(F.sequence(F.lit(0), m), row)

    return F.get(F.aggregate(F.sequence(F.lit(1), m + n), start, step), m)


def series_by(df: DataFrame, id_col: str, x: str, y: str, ma: str) -> DataFrame:
    """Per id the ordered points ``(id, x, y, ma)``, sorted by id and x.

    Long format instead of one array per id: the sort is range-partitioned, so a very long
    series is split over tasks rather than collected into one row.
    """
    pts = df.select(F.col(id_col), F.col(x).alias("x"), F.col(y).alias("y"), F.col(ma).alias("ma"))
    return pts.orderBy(id_col, "x")
