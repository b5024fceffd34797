import zlib

import pytest

from tonekit.llm.quality_model import op6_quality, score, fit

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op6_quality(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(got[i]["predicted"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert sum(p == q for p, q in test) / len(test) >= 0.95
    # no label of a held-out row counts
    again = {r["doc_id"]: r["score"] for r in op6_quality(spark, folder).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_labels_of_held_out_rows_are_not_read(spark, put, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    folder = put("documents", [tuple(r) for r in docs.collect()], docs.schema)
    put("labels", labels, LABELS)
    one = sorted(map(tuple, op6_quality(spark, folder).collect()))
    put("labels", [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], LABELS)
    assert sorted(map(tuple, op6_quality(spark, folder).collect())) == one


def test_odd_rows(spark, put, put_docs):
    folder = put_docs([(1, None), (2, ""), (3, "x" * 300_000), (4, "a b"), (4, "a b"), (None, "z")])
    put("labels", [], LABELS)
    assert [r["score"] for r in op6_quality(spark, folder).collect()] == [0.5] * 6
    put("labels", [(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0)], LABELS)
    assert {r["score"] for r in op6_quality(spark, folder).collect()} == {1.0}
    folder = put_docs([(i, "good words here" if i % 2 else "BAD!! $$$ ###") for i in range(40)] + [(100, None)])
    put("labels", [(i, i % 2, 0) for i in range(40)], LABELS)  # too few to train a dictionary
    got = {r["doc_id"]: r["predicted"] for r in op6_quality(spark, folder).collect()}
    assert all(got[i] == i % 2 for i in range(40)) and got[100] in (0, 1)
    assert op6_quality(spark, put_docs([])).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 0.1, "t")], "doc_id long, text string, id double, y string")
    labels = spark.createDataFrame([], LABELS)
    got = score(docs, fit(docs, labels), out="s")
    assert got.columns == ["doc_id", "text", "id", "y", "s"] and got.first()["s"] == pytest.approx(0.5)
