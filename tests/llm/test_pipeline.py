import re

import corpus_pipeline
from test_near_dup import expected
from test_packing import check as check_packed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good}
    assert sum(d in ids for d, q in labels.items() if q) >= 0.95 * sum(labels.values())
    good = spark.createDataFrame(good, docs.schema)

    single = stage["near_dup"](spark, good, sf_dir)
    want = {d for d, _, _, kept in expected([(r["doc_id"], r["text"]) for r in good.collect()]) if kept}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    clean = stage["secrets"](spark, single, sf_dir)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not [r for r in clean.collect() if re.search(r'token = "[0-9a-f]{40}"', r["text"] or "")]

    mixed = stage["mixing"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    most = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most <= 2

    packed = stage["packing"](spark, clean, sf_dir).collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in clean.collect()])


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    per = rows.groupBy("sequence_id").sum("length").collect()
    assert per and max(r[1] for r in per) <= 1024


def test_empty(spark, put, put_docs):
    folder = put_docs([])
    put("labels", [], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, folder).collect() == []
