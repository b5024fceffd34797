import math
import random

import duckdb

from tonekit.llm import topk
from tonekit.llm.topk import ORACLES, op7_topk

VECS = "vec_id long, embedding array<float>, label int"


def expected(rows, k=5, every=50):
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vs:
        if q % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vs if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_op7(spark, sf_dir, rows):
    want = expected(rows("embeddings", "vec_id, embedding"))
    assert got(op7_topk(spark, sf_dir)) == want
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(sql.execute(ORACLES["op7_topk"]).fetchall()) == want


def test_chunks_blocks_copies_and_ties(spark, put, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 50)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "FIRST", 7)
    r = random.Random(8)
    few = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(9)]
    vecs = [(i, r.choice(few) if i % 3 else [r.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    vecs += [(600 + i, few[0]) for i in range(300)]
    folder = put("embeddings", [(i, v, 0) for i, v in vecs], VECS)
    vecs = [(x["vec_id"], list(x["embedding"])) for x in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(op7_topk(spark, folder)) == expected(vecs)


def test_odd_rows(spark, put):
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (50, []),
            (51, []), (100, [1.0]), (150, None), (200, [nan, 0.0]), (None, [1.0, 1.0]), (6, [-3.0, 1.0])]
    folder = put("embeddings", [(i, v, 0) for i, v in vecs], VECS)
    assert got(op7_topk(spark, folder)) == expected(vecs) == [(0, 1, 5, 98304), (0, 2, 6, -65536), (50, 1, 51, 0)]
    assert op7_topk(spark, put("embeddings", [], VECS)).collect() == []


def test_repeated_query_rows(spark, put, monkeypatch):
    monkeypatch.setattr(topk, "FIRST", 2)
    one, two = [1.0, 0.5], [0.5, 0.5]
    for copies in (1, 2, 6, 9):
        vecs = [(i, one) for i in [0] * copies + [1, 1, 1, 1, 1, 1, 1, 2, 3, 4, 5, 6, 50, 50]] + [(7, two), (8, [0.25, 0.0])]
        want = [r for q in (0, 50) for r in expected([(i, v) for i, v in vecs if i != q] + [(q, one)]) if r[0] == q]
        assert got(op7_topk(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS))) == want
    vecs = [(i, one) for i in (0, 0, 1, 2, 3, 4, 5)] + [(7, two)]
    assert [r[2] for r in got(op7_topk(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS)))] == [1, 2, 3, 4, 5]
    # a query id with many vectors of its own
    vecs = [(0, [4.0 + n, 4.0]) for n in range(12)] + [(i, [1.0 / i, 0.5]) for i in range(1, 9)]
    want = sorted(x for n in range(12) for x in expected([(0, [4.0 + n, 4.0])] + vecs[12:]) if x[0] == 0)
    assert got(op7_topk(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS))) == want


def test_huge_components_take_no_part(spark, put):
    vecs = [(0, [1.0, 2.0]), (1, [1e30, 0.0]), (2, [-3e38, 3e38]), (3, [1e6, -1e6]), (4, [0.5, 0.5])]
    folder = put("embeddings", [(i, v, 0) for i, v in vecs], VECS)
    assert got(op7_topk(spark, folder)) == expected([v for v in vecs if v[0] in (0, 3, 4)])
