import hashlib
import re
from collections import defaultdict

import pytest

from tonekit.llm import mixing
from tonekit.llm.mixing import mixed_documents, op1_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes, share=1.5, most=2):
    """Reshare what is over a limit until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = budget - sum(most * sizes[s] for s in full)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {**target, **{s: most * sizes[s] for s in full}}
        full |= over


def check(got, docs, near=0.02):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {d: s for d, _, s in docs}
    for _, t, s in docs:
        sizes[s] += size_of(t)
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
    for s, t in expected_targets(sizes).items():
        assert target[s] == pytest.approx(t, rel=1e-9)
        smallest = min([size_of(x) for _, x, y in docs if y == s and size_of(x)], default=0)
        assert abs(taken[s] - t) <= max(near * t, smallest)


def test_op1(spark, sf_dir, rows):
    got = op1_mixing(spark, sf_dir).collect()
    check(got, rows("documents", "doc_id, text, source"))
    assert sorted(got) == sorted(op1_mixing(spark, sf_dir).collect())


def test_boundary_is_refined(spark, put, monkeypatch):
    """Few bits a level and a small region: the levels below the first do the work."""
    monkeypatch.setattr(mixing, "DIGIT", 4)
    monkeypatch.setattr(mixing, "REGION", 4)
    monkeypatch.setattr(mixing, "REGION_MOST", 8)
    docs = [(i, "w " * (1 + i % 7), "a" if i % 3 else f"s{i % 11}") for i in range(3000)]
    folder = put("documents", [(i, t, "en", s, 0) for i, t, s in docs], DOCS)
    got = op1_mixing(spark, folder).collect()
    check(got, docs, near=0.002)
    # below the threshold all are taken, above none: at most the region lies between
    by = defaultdict(list)
    source = {i: s for i, _, s in docs}
    for r in got:
        h = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:3], 16)
        by[source[r["doc_id"]]].append((h, r["taken"] // r["size"]))
    for pairs in by.values():
        pairs.sort()
        high = max(c for _, c in pairs)
        low = min(c for _, c in pairs)
        mixed = [h for h, c in pairs if c == low]
        if high > low:
            first = min(mixed)
            inside = [h for h, c in pairs if c == high and h > first]
            assert len(inside) <= 8 + 40


def test_odd_rows(spark, put):
    docs = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "x " * 500, None), (5, "one", "Z"), (6, " ", "empty")]
    folder = put("documents", [(i, t, "en", s, 0) for i, t, s in docs], DOCS)
    check(op1_mixing(spark, folder).collect(), docs, near=0.5)  # whole documents come no nearer
    same = [(7, "a b c", "s")] * 4 + [(8, "a", "t"), (None, "q r", "t"), (None, "q r", "t")]
    folder = put("documents", [(i, t, "en", s, 0) for i, t, s in same], DOCS)
    assert len(op1_mixing(spark, folder).collect()) == 7
    folder = put("documents", [], DOCS)
    assert op1_mixing(spark, folder).collect() == []


def test_mixed_documents_repeat_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS size", "2 AS copies", "3 AS h", "4 AS target")
    mixed = mixed_documents(extra)
    assert mixed.columns == extra.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in op1_mixing(spark, sf_dir).collect() if r["size"]}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in got.items() if d in want}


def test_clashing_internal_names(spark):
    from tonekit.llm.mixing import mixed_documents
    names = ["_words", "_copies", "_id", "row", "copies", "source_", "low"]
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2], *range(7)) for i in range(40)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(7))}
