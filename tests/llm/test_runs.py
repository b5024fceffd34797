import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tonekit.llm import runs
from tonekit.llm.common import WORD
from tonekit.llm.runs import find_runs, op12_runs, periodic_runs


def brute(words, least=12):
    """Runs by every period: maximal stretches, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


def planted(doc_id, text):
    words = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    found = brute(words)
    dropped = set()
    for s, length, q in found:
        dropped.update(range(s + q, s + length))
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def codes_of(docs):
    codes = np.array([w for d in docs for w in d], np.int32)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    begins = np.cumsum([0] + [len(d) for d in docs])[:-1]
    return codes, doc, begins


@pytest.mark.parametrize("least", [2, 12])
def test_against_every_period(least):
    r = random.Random(least)
    for trial in range(150):
        docs = []
        for _ in range(r.randint(1, 6)):
            d = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 60))]
            for _ in range(r.randint(0, 3)):
                unit = [r.randrange(4) for _ in range(r.randint(1, 9))]
                d[r.randint(0, len(d)):0] = (unit * 9)[:r.randint(2, 40)]
            docs.append(d)
        codes, doc, begins = codes_of(docs)
        s, e, p = find_runs(codes, doc, begins, least)
        mine = [[] for _ in docs]
        for x, y, z in zip(s.tolist(), e.tolist(), p.tolist()):
            mine[doc[x]].append((x - begins[doc[x]], y - x, z))
        assert mine == [brute(d, least) for d in docs]


def test_long_runs_stay_near_linear():
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 30000:
        a, b = b, b + a
    for doc in ([7] * 60000, list(range(50)) * 1200, list(range(30000)) * 2, b[:3000]):
        codes, of, begins = codes_of([fib, doc, doc[:100]])
        s, e, p = find_runs(codes, of, begins)
        if len(set(doc)) != 2:
            n, q = len(doc), len(set(doc))
            assert (2, n + 2, q) in set(zip(s.tolist(), e.tolist(), p.tolist()))
        else:
            assert [(x - 2, y - x, z) for x, y, z in zip(s.tolist(), e.tolist(), p.tolist()) if 2 <= x < 3002] == brute(doc)


def test_whole_table(spark, sf_dir, rows):
    docs = [d for d in rows("documents", "doc_id, text") if len(d[1] or "") < 20000]
    want = sorted((expected(*d) for d in docs), key=str)
    small = {d[0] for d in docs}
    assert [r for r in got(op12_runs(spark, sf_dir)) if r[0] in small] == want


def test_odd_rows(spark, put, put_docs, monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 300)
    r = random.Random(4)
    texts = [None, "", " \n\t ", "a", "a " * 12, " a\x0bb\x0ca b\x1c   é é", "x y " * 40, "long " * 3000 + "tail",
             "\n".join(["one two three"] * 9), *[" ".join(r.choices("ab", k=r.randint(0, 50))) for _ in range(60)]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[6]), (7, texts[6]), (None, "u v w " * 9), (None, None)]
    assert got(op12_runs(spark, put_docs(docs))) == sorted((expected(*d) for d in docs), key=str)
    assert op12_runs(spark, put_docs([])).collect() == []


def test_operator_keeps_spans_and_texts(spark):
    df = spark.createDataFrame([("k", "go " * 13 + "on", 1, 2)], "name string, body string, runs int, n_words int")
    (row,) = periodic_runs(df, "name", "body").collect()
    assert tuple(row) == ("k", 14, [(0, 13, 1)], "go on")
