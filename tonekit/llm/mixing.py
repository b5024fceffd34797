"""Operator 1: mixing sources to target weights, by hash-threshold histograms.

Targets. Sources in code point order (null last) get the weights 5, 2, 1, again and again, and share
``share`` times all words; no target passes ``most`` times its source's words, and what is over
goes to the others by weight. The shares settle at one level L: a source's target is the
smaller of L x weight and its limit, so L follows from running sums over the sources ordered by
limit / weight (one row per source).

Selection. A source gives whole copies of itself as often as its target holds it, and a part of its
documents once more for the remainder. Documents have a fixed hash of 36 bits; those below a threshold
are taken. The threshold is found from sums of words per source and hash bucket (4096 of them, added
up on the map side): the bucket in which the running sum passes the remainder is the boundary. A
boundary bucket with many documents is parted into 4096 again by the next bits, twice at most; all
other buckets are decided. Of the last few documents around the boundary (at least ``REGION`` where
there are so many) those that fit are taken from the largest down, and then one more if the
sum comes nearer to the target. Nothing is sorted but that region, and documents are read by a filter.

Defined results: a null or empty text has no words and is taken like any other (it counts 0); rows
with the same id and size share one hash and are decided together; a source whose texts have no
words has target 0 and is taken once; a null id has a hash of its own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonekit.llm.common import n_words, staged, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Hash bits: LEVELS digits of DIGIT bits each, from md5 (so that any engine gets the same).
DIGIT, LEVELS = 12, 3
#: Documents around the boundary among which the last ones are chosen, and the most of them (more
#: only if they have one hash).
REGION, REGION_MOST = 48, 512
#: Sources up to which their table is broadcast.
FEW_SOURCES = 10_000


def id_hash(c: Column) -> Column:
    """36 bits of the md5 of an id as text."""
    text = F.md5(F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(text, 1, DIGIT * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` sums: one row per source in, one out."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") - 1) % len(WEIGHTS) + 1)
    limit = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("limit", limit)
    every = Window.partitionBy()
    upto = Window.orderBy((F.col("limit") / F.col("weight")), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # ordered by limit / weight: the first source that its level does not fill sets the level for all after it
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    whole = Window.orderBy((F.col("limit") / F.col("weight")), "place").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", level).withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    return rows.select("source", "source_size", F.least(
        "limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _digit(h: Column, level: int) -> Column:
    return F.shiftright(h, DIGIT * (LEVELS - 1 - level)).bitwiseAND((1 << DIGIT) - 1)


def _same_source(a: DataFrame, b: DataFrame, more: list[Column] | None = None) -> Column:
    return reduce(Column.__and__, more or [], a["source"].eqNullSafe(b["source_"]))


def _regions(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """``source_, low, high, room``: hashes below ``low`` are taken, those up to ``high`` are looked at
    one by one for the ``room`` that is left. One row per source."""
    done, open_ = [], goals.select(F.col("source").alias("source_"), F.lit(0).cast("long").alias("base"),
                                   F.col("rest").alias("room"))
    for level in range(LEVELS):
        step = 1 << (DIGIT * (LEVELS - 1 - level))
        prefix = F.col("h") - F.col("h") % F.lit(step << DIGIT)
        part = docs if level == 0 else docs.withColumn("prefix", prefix).join(
            open_.select(F.col("source_").alias("s_"), "base"),
            F.col("source").eqNullSafe(F.col("s_")) & (F.col("prefix") == F.col("base")), "left_semi")
        sums = (part.groupBy("source", _digit(F.col("h"), level).alias("digit"))
                    .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("h").alias("last")))
        # at most 4096 rows per source from here on
        before = Window.partitionBy("source_").orderBy("digit")
        rows = sums.join(open_, sums["source"].eqNullSafe(open_["source_"])).select(
            "source_", "base", "room", "digit", "size", "n",
            F.sum("size").over(before).alias("upto"))
        rows = rows.withColumn("over", F.col("upto") > F.col("room"))
        # documents between a bucket and the boundary, on either side of it
        near = Window.partitionBy("source_", "over").orderBy(F.when(F.col("over"), F.col("digit")).otherwise(-F.col("digit")))
        rows = rows.withColumn("docs", F.sum("n").over(near)).withColumn("nth", F.row_number().over(near))
        inside = F.when(F.col("over"), F.col("docs") - F.col("n") < REGION).otherwise(F.col("docs") <= REGION)
        found = rows.withColumn("inside", inside).groupBy("source_", "base", "room").agg(
            F.max(F.when(~F.col("over"), F.col("upto"))).alias("below_edge"),
            F.max(F.when(~F.col("over") & ~F.col("inside"), F.col("upto"))).alias("below_low"),
            F.min(F.when(F.col("over"), F.col("digit"))).alias("edge"),
            F.min(F.when(F.col("inside"), F.col("digit"))).alias("start"),
            F.max(F.when(F.col("inside"), F.col("digit"))).alias("end"),
            F.max(F.when(F.col("over") & (F.col("nth") == 1), F.col("n"))).alias("first"))
        split = (F.col("first") > REGION_MOST) if level < LEVELS - 1 else F.lit(False)
        found = staged(found.withColumn("split", split), f"level{level}")
        done.append(found.where(~F.col("split")).select(
            "source_", (F.col("base") + F.col("start") * step).alias("low"),
            (F.col("base") + (F.col("end") + 1) * step).alias("high"),
            (F.col("room") - F.coalesce("below_low", F.lit(0))).alias("room")))
        open_ = found.where("split").select("source_", (F.col("base") + F.col("edge") * step).alias("base"),
                                            (F.col("room") - F.coalesce("below_edge", F.lit(0))).alias("room"))
    return reduce(DataFrame.unionByName, done)


def _last_ones(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """``source, hashes``: hashes in the region that are taken besides, a bounded list per source."""
    near = docs.join(regions, _same_source(docs, regions, [docs["h"] >= regions["low"], docs["h"] < regions["high"]]))
    groups = near.groupBy("source", "h", "room").agg(F.sum("size").alias("size"))
    # at most REGION_MOST hashes and those of one bucket more
    lists = groups.groupBy("source", "room").agg(
        F.sort_array(F.collect_list(F.struct("size", "h")), asc=False).alias("all"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<long>").alias("hs"))
    fill = F.aggregate("all", start, lambda acc, x: F.when(
        x["size"] <= acc["room"], F.struct((acc["room"] - x["size"]).alias("room"),
                                           F.concat(acc["hs"], F.array(x["h"])).alias("hs"))).otherwise(acc))
    lists = lists.withColumn("fill", fill)
    # the smallest that was left out, if the sum comes nearer to the target with it
    out = F.filter("all", lambda x: ~F.array_contains(F.col("fill.hs"), x["h"]))
    last = F.element_at(out, -1)
    more = F.when((F.size(out) > 0) & (last["size"] < 2 * F.col("fill.room")), F.array(last["h"])).otherwise(
        F.array().cast("array<long>"))
    return lists.select(F.col("source").alias("source_"), F.concat("fill.hs", more).alias("hashes"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, most: float):
    """The stored sizes ``doc_id, source, size, h``, the targets, and per source what decides a document's copies by its
    hash: ``source_, source_size, target, whole, low, hashes`` (broadcast if there are few sources)."""
    own = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                             n_words(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h")), "sizes")
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    goals = staged(goals.withColumn("whole", whole).withColumn(
        "rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size"))
        .otherwise(F.lit(-1.0))), "targets")
    few = goals.count() <= FEW_SOURCES  # one row per source, with a bounded list: else a shuffle join
    small = F.broadcast if few else lambda df: df
    short = goals.where(F.col("rest") > 0)
    regions = _regions(own, short)
    chosen = regions.join(_last_ones(own, small(regions)).withColumnRenamed("source_", "s_"),
                          F.col("source_").eqNullSafe(F.col("s_")), "left").select("source_", "low", "hashes")
    plan = goals.join(chosen, goals["source"].eqNullSafe(chosen["source_"]), "left").select(
        F.col("source").alias("source_"), "source_size", "target", "whole", "low", "hashes")
    return own, goals, small(staged(plan, "plan"))


def _copies(h: Column) -> Column:
    extra = F.coalesce((h < F.col("low")) | F.array_contains("hashes", h), F.lit(False))
    return F.col("whole") + extra.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """How often each document is taken.

    Returns a stored table ``doc_id, source, size, h, source_size, target, copies`` with a row per
    document, and ``source, source_size, target`` with a row per source.
    """
    own, goals, plan = _plan(docs, id_col, text_col, source_col, share, most)
    taken = own.join(plan, own["source"].eqNullSafe(F.col("source_"))).select(
        "doc_id", "source", "size", "h", "source_size", "target", _copies(F.col("h")).alias("copies"))
    return taken, goals.select("source", "source_size", "target")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns, whatever their names.

    The sources' plan comes to the rows: no text is shuffled. Rows with one id and source have one hash and are taken
    equally often.
    """
    _, _, plan = _plan(docs, "doc_id", "text", "source", SHARE, MOST)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(plan, F.col("row.source").eqNullSafe(F.col("source_"))).select("row", _copies(id_hash(F.col("row.doc_id"))).alias("copies"))
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: size, source size, target and words that the mix takes of each."""
    taken, _ = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}  # the choice around the boundary is a fold: tests compare with plain Python
