"""Global positions and running sums on larger frames with payload columns, AQE coalescing on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonekit.operators.clean import drop_by_position
from tonekit.operators.stats import histogram_pct, mann_whitney
from tonekit.operators.windows import global_row_number, prefix_sum, speech_progress


@pytest.fixture(autouse=True)
def coalescing(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def frame(spark, n):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.lit("x"), 30).alias("pay"), F.lit(1).alias("one"))


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000])
def test_numbers_and_sums_are_complete(spark, n):
    df = frame(spark, n)
    got = global_row_number(df, ["k"], "rn").agg(F.count("pay"), F.countDistinct("rn"), F.max("rn"), F.sum((F.col("rn") != F.col("k") + 1).cast("int"))).first()
    assert tuple(got) == (n, n, n, 0)
    got = prefix_sum(df, "k", "one").agg(F.count("pay"), F.max("cum"), F.sum((F.col("cum") != F.col("k") + 1).cast("int"))).first()
    assert tuple(got) == (n, n, 0)


def test_drop_by_position_keeps_the_rest(spark):
    df = frame(spark, 100_000)
    out = drop_by_position(df, ["k"], [0, 3], drop_last=True).agg(F.count("pay"), F.min("k"), F.max("k")).first()
    assert tuple(out) == (99_997, 1, 99_998)
    assert drop_by_position(df, ["k"], []).count() == 100_000


def test_mann_whitney_with_many_ties(spark):
    df = spark.range(5_000_000).select(F.lit(0.0).alias("v"), (F.col("id") % 2).alias("g"))
    r = mann_whitney(df, "v", "g", 1, 0).first()
    assert r["n1"] == r["n2"] == 2_500_000 and r["ties"] == pytest.approx(1.25e20) and r["u1"] == pytest.approx(3.125e12)


def test_histogram_edges_as_numpy(spark):
    for lo, hi in ((-0.9, 0.9), (-1.0, 1.0)):
        values = [round(lo + k * 0.0001, 4) for k in range(int(round((hi - lo) * 10000)) + 1)]
        df = spark.createDataFrame([(v, "g") for v in values], "v double, g string")
        got = [r["n"] for r in histogram_pct(df, "v", "g").orderBy("bin").collect()]
        assert got == np.histogram(values, bins=20)[0].tolist()


def test_progress_numbers_the_rows_that_are_there(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9000), ("b", 5)], "id string, rank_sentence int")
    got = sorted((r["id"], r["rank_sentence"], r["cumcount"], r["percentage"]) for r in speech_progress(df, total_col=None).collect())
    assert [g[:3] for g in got] == [("a", 1, 1), ("a", 3, 2), ("a", 9000, 3), ("b", 5, 1)]
    assert [g[3] for g in got] == pytest.approx([1 / 3, 2 / 3, 1, 1])
