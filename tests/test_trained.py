"""The trained ordinal scorer: held-out accuracy, the same result twice, odd rows."""
from pyspark.sql import functions as F

from tonekit.operators.trained import ordinal_class, score_trained, train_ordinal

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_repeatability(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = docs.select("doc_id", "text", F.col("quality").alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held"))
    model = train_ordinal(rows.where("NOT held"))
    scored = score_trained(rows.where("held"), model).collect()
    right = [sum((r.probability >= 0.5) == (r.label == 1) for r in scored if r.label == y) / sum(r.label == y for r in scored) for y in (0, 1)]
    assert len(scored) > 80 and sum(right) / 2 >= 0.75, right
    again = {r.doc_id: r.probability for r in score_trained(rows.where("held"), train_ordinal(rows.where("NOT held"))).collect()}
    assert all(abs(again[r.doc_id] - r.probability) < 1e-9 for r in scored)
    assert {r.ordinal for r in scored} >= {0, 4}


def test_odd_rows(spark):
    rows = spark.createDataFrame([("good fine", 1), ("bad poor", 0), ("good", 1), ("bad", 0), ("none", None), (None, 1)], "text string, label int")
    model = train_ordinal(rows)
    got = {r.text: r for r in score_trained(rows, model).collect()}
    assert got["good"].probability > 0.5 > got["bad"].probability and 0 <= got[None].probability <= 1
    assert train_ordinal(rows.where("label = 1")) is None
    cuts = spark.createDataFrame([(x,) for x in (0.0, 0.19, 0.2, 0.5, 0.6, 0.8, 1.0)], "p double")
    assert [r[0] for r in cuts.select(ordinal_class(F.col("p"))).collect()] == [0, 0, 1, 2, 3, 4, 4]
