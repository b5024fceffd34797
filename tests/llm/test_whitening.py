import math
import random

import numpy as np

from tonekit.llm import whitening
from tonekit.llm.whitening import corrections, leading, op11_whitening, whitened

VECS = "vec_id long, embedding array<float>, label int"


def expected(vecs, k=16):
    """By numpy's dense solver: per row its id, exact deviation and whitened components."""
    xs = [(i, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for i, v in vecs]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    mean = np.array([s / n for s in sums])
    m = np.array(fit, float) - mean
    cov = m.T @ m / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, e / np.trace(cov), [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x, float) - mean) @ u / np.sqrt(e))
                                  for i, x in xs]


def check(rows, vecs, k=16, tol=1e-8):
    n, explained, want = expected(vecs, k)
    k = len(explained)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(rows) == k * len(want)
    flip = None
    for i, deviation, white in want:
        got = [by[i][c + 1] for c in range(k)]
        assert {(r["n"], r["deviation"]) for r in got} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in got], explained, rtol=1e-9)
        values = np.array([r["whitened"] for r in got])
        if flip is None and np.abs(white).min() > 1e-6:
            flip = np.sign(values * white)
        if flip is not None:
            assert np.allclose(values * flip, white, atol=tol)
        assert got[0]["identity_error"] < 1e-9
    assert flip is not None


def test_whole_table(spark, sf_dir, rows):
    vecs = [(i, v) for i, v in rows("embeddings", "vec_id, embedding")]
    check(op11_whitening(spark, sf_dir).collect(), vecs)


def test_wide_vectors_many_blocks_and_parts(spark, put, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 40)
    monkeypatch.setattr(whitening, "PARTS", 2)
    r = np.random.default_rng(5)
    scale = np.concatenate([np.linspace(9, 2, 20), np.full(180, 0.7)])
    vecs = [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(r.standard_normal((700, 200)) * scale)]
    vecs += [(1000 + i, vecs[3][1]) for i in range(300)]  # a hot vector counts once
    check(op11_whitening(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS)).collect(), vecs, tol=1e-7)


def test_solver_on_close_and_equal_values():
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((300, 300)))[0]
    values = np.concatenate([[50, 50, 50, 20, 19.99, 19.98], np.linspace(10, 0, 294)])
    a = (q * values) @ q.T
    passes = []
    e, u = leading(lambda x: passes.append(1) or a @ x, 300, 16)
    assert np.allclose(e, values[:16], rtol=1e-12)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * 50
    assert np.abs(u.T @ u - np.eye(16)).max() < 1e-13
    assert len(passes) < 150


def test_corrections_solve_the_projected_equation():
    r = np.random.default_rng(3)
    a = r.standard_normal((30, 30))
    a = a + a.T
    u = np.linalg.qr(r.standard_normal((30, 2)))[0]
    locked = np.linalg.qr(np.concatenate([u, r.standard_normal((30, 3))], axis=1))[0][:, 2:]
    e = np.sum(u * (a @ u), axis=0)
    res = a @ u - u * e
    t = corrections(lambda x: a @ x, locked, u, e, res, 40)
    for j in range(2):
        q = np.concatenate([locked, u[:, j:j + 1]], axis=1)
        p = np.eye(30) - q @ q.T
        assert np.allclose(p @ (a - e[j] * np.eye(30)) @ p @ t[:, j], -p @ res[:, j], atol=1e-8)


def test_odd_rows(spark, put):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0, 0.5]), (5, [0.5, 0.5, 1.0]), (6, [-3.0, 1.0, 0.0]), (6, [-3.0, 1.0, 0.0]), (None, [1.0, 1.0, 7.0])]
    bad = [(1, None), (2, [1.0, None, 1.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (7, []), (8, [1.0]), (9, [1e30, 0.0, 0.0])]
    df = op11_whitening(spark, put("embeddings", [(i, v, 0) for i, v in good + bad], VECS))
    rows = df.collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), c) for i, _ in good for c in (1, 2, 3))
    assert {r["n"] for r in rows} == {4}
    again = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good], "vec_id long, embedding array<double>, n int, component int, _cells int")
    assert len(whitened(again, components=2).collect()) == 10
    # one distinct vector varies in nothing; an empty table has nothing
    assert op11_whitening(spark, put("embeddings", [(i, [1.0, 2.0], 0) for i in range(4)], VECS)).collect() == []
    empty = op11_whitening(spark, put("embeddings", [], VECS))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_flat_directions_and_large_entries(spark, put):
    r = random.Random(1)
    vecs = [(i, [float(x := r.randint(-9, 9)), float(2 * x), 3.0, float(r.randint(-9, 9))]) for i in range(60)]
    rows = op11_whitening(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS)).collect()
    assert {x["component"] for x in rows} == {1, 2} and rows[0]["identity_error"] < 1e-9
    vecs = [(i, [2.0 ** 30 * r.randint(-9, 9), float(r.randint(-9, 9))]) for i in range(40)]
    got = op11_whitening(spark, put("embeddings", [(i, v, 0) for i, v in vecs], VECS)).collect()
    want = {i: dev for i, dev, _ in expected(vecs)[2]}
    assert {x["vec_id"]: x["deviation"] for x in got} == {i: v if v < 2 ** 63 else None for i, v in want.items()}
