"""Properties of query outputs on the smallest scale factor."""
from collections import defaultdict

from pyspark.sql import functions as F

from tonekit.operators import stats
from tonekit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_crosstab_rows_sum_to_one(spark):
    for r in QUERIES["crosstab_classes"](spark, SF).collect():
        assert abs(r.negative + r.neutral + r.positive - 1.0) < 1e-5
    sums = defaultdict(float)
    for r in QUERIES["crosstab_rounded"](spark, SF).collect():
        sums[r.compound_round] += r.share
    assert all(abs(v - 1.0) < 1e-5 for v in sums.values())


def test_progress_ends_at_one(spark):
    rows = QUERIES["speech_progress"](spark, SF).groupBy("id").agg(
        F.max("percentage").alias("mx"), F.min("cumcount").alias("first"), F.count(F.lit(1)).alias("n"),
        F.max("cumcount").alias("last")).collect()
    assert all(r.mx == 1.0 and r.first == 1 and r.last == r.n for r in rows)


def test_shares_sum_to_hundred(spark):
    by_q = defaultdict(float)
    for r in QUERIES["ordinal_share"](spark, SF).collect():
        by_q[r.quality] += r.pct
    assert all(abs(v - 100) < 1e-4 for v in by_q.values())
    by_c = defaultdict(float)
    for r in QUERIES["group_share"](spark, SF).collect():
        by_c[r.corpus] += r.perc
    assert all(abs(v - 1) < 1e-4 for v in by_c.values())


def test_histogram_counts_cover_all_rows(spark):
    hist = QUERIES["hist_by_group"](spark, SF).groupBy("quality").agg(F.sum("n").alias("n")).collect()
    med = {r.quality: r.n for r in QUERIES["median_by_group"](spark, SF).collect()}
    assert {r.quality: r.n for r in hist} == med


def test_group_size_drops_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k: r.size for r in stats.group_size(df, ["k"]).collect()} == {"a": 2}


def test_sentence_counts_agree(spark):
    n_split = QUERIES["sentence_split"](spark, SF).count()
    assert QUERIES["score_compound"](spark, SF).count() == n_split
    assert QUERIES["language_id"](spark, SF).count() == n_split
    assert QUERIES["sentiment_table"](spark, SF).count() == n_split
