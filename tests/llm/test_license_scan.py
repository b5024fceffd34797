import math
import random

import duckdb
import pytest

from tonekit.llm import license_scan as ls
from tonekit.llm.license_scan import ORACLES, PHRASES, TEMPLATES, license_scan, op13_license_scan, words_of


def expected(doc_id, text, templates=TEMPLATES, threshold=0.9):
    """All blocks against all templates, by sets."""
    words = words_of(text or "")
    places, base, own, best = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = words_of(phrase)
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, notice in templates:
        t = words_of(notice)
        span = 8
        while span < len(t):
            span *= 2
        for s in range(0, len(words), span):
            share = len(set(t) & set(words[s:s + 2 * span]))
            if share >= math.ceil(threshold * len(set(t))):
                own.add(label)
                best = max(best, share / len(set(t)))
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), 1.0 if places else best)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_and_sql(spark, sf_dir, rows):
    want = sorted((expected(*d) for d in rows("documents", "doc_id, text")), key=str)
    mine = got(op13_license_scan(spark, sf_dir))
    assert mine == want
    assert {"mit", "apache-2.0"} & {x for r in mine for x in r[6].split(",")}
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(sql.execute(ORACLES["op13_license_scan"]).fetchall(), key=str) == want


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_every_threshold_against_all_blocks(spark, put_docs, monkeypatch, threshold):
    monkeypatch.setattr(ls, "BATCH", 400)
    r = random.Random(int(threshold * 100))
    pool = sorted({w for _, t in TEMPLATES for w in words_of(t)})
    docs = []
    for i in range(150):
        words = r.choices(pool + ["zebra", "ñandú"] * 20, k=r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            notice = words_of(r.choice(TEMPLATES)[1])
            kept = [w for w in notice if r.random() < 0.93]
            at = r.randint(0, len(words))
            words[at:at] = kept
        docs.append((i, " ".join(words).title()))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((expected(*d, threshold=threshold) for d in docs), key=str)
    assert got(license_scan(rows, threshold=threshold)) == want


def test_odd_rows(spark, put_docs):
    notice = "Released under the MIT License."
    long = "lorem ipsum " * 4000 + notice + " dolor" * 5000 + " All Rights Reserved, all rights reserved"
    texts = [None, "", "?!", "cc", "CC-BY cc by", "General public; LICENSE", "all rights reservedé", "ALL RIGHTS\x00RESERVED",
             "İ KELVIN K All rights reserved", notice, notice.replace("MIT", "Apache"), long, "a\x7fb{c|d}e~f`g_h@i[j\\k]l^m/n:o;1"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(9, notice), (9, notice), (9, "else"), (None, notice), (None, None)]
    mine = got(op13_license_scan(spark, put_docs(docs)))
    assert mine == sorted((expected(*d) for d in docs), key=str)
    assert {r[0]: r[6] for r in mine if r[0] in (5, 9, 10) and r[1] > 1} == {5: "gpl", 9: "mit", 10: ""}
    assert op13_license_scan(spark, put_docs([])).collect() == []


def test_clashing_columns_and_own_templates(spark):
    df = spark.createDataFrame([("k", "one two three four", 1, 2, "x", 3)],
                               "name string, body string, row_no int, n_words int, blocks string, label int")
    (row,) = license_scan(df, "name", "body", templates=[("own", "four three two one")]).collect()
    assert tuple(row) == ("k", 4, 0, None, None, "", "own", 1.0)
