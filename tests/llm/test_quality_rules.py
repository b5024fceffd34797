import re
from collections import Counter

from tonekit.llm.quality_rules import measures, op8_quality_rules

SPACE = " \t\n\x0b\f\r"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def check(got, docs):
    want = sorted((d, *base(t)) for d, t in docs)
    assert sorted(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op8(spark, sf_dir, rows):
    check(op8_quality_rules(spark, sf_dir).collect(), rows("documents", "doc_id, text"))


def test_verdict_keeps_good_and_drops_bad(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in op8_quality_rules(spark, folder).collect() if not r["base_failed"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in kept}
    good = [kept[d] for d, q in labels.items() if q == 1]
    bad = [kept[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_odd_rows(spark, put_docs):
    eight = "a b c d e f g h "
    texts = [None, "", " \n\t ", "x" * 200_000, eight * 2, eight * 9 + "i", "w " * 30_000, "é ü ##|| 日本語 <>&%$*#", "l\nl\n\n \nl\r\nm",
             "one " * 19, " ".join(f"w{i}" for i in range(40)), eight + "x " + eight + "y b c d e f g h z", "a\x1cb \x85c d"]
    docs = list(enumerate(texts)) + [(3, "dup"), (3, "dup")]
    check(op8_quality_rules(spark, put_docs(docs)).collect(), docs)
    assert op8_quality_rules(spark, put_docs([])).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, n_words int, lines string")
    assert measures(clash).first()["n_words"] == 2


def test_native(spark, sf_dir):
    plan = op8_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
