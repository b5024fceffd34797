import random
import re

import numpy as np
import pytest

from tonekit.llm import near_dup
from tonekit.llm.near_dup import M, may_be_alike, op4_near_dup, shingles, sketch


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4)))


def expected(docs):
    """Brute force over pairs that share a shingle."""
    sets = [set_of(t) for _, t in docs]
    by, parent = {}, list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1:]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    for i, (d, _) in enumerate(docs):  # rows with one id belong together
        for j, (e, _) in enumerate(docs):
            if d == e and i < j and sets[i] and sets[j]:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_op4_against_brute_force(spark, scale):
    import duckdb
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{scale}/documents.parquet'").fetchall()
    assert got(op4_near_dup(spark, f"/root/testdata/{scale}")) == expected(docs)


def test_groups_and_chains(spark, put_docs):
    """Large groups of variants, chains whose ends are unlike, and pairs around the limit."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)] * 50
    for _ in range(400):  # near copies of one text
        v = base[:]
        for _ in range(r.randint(1, 2)):
            v[r.randrange(len(v))] = word()
        texts.append(" ".join(v))
    for _ in range(5):  # chains: each changes a little of the one before
        v = [word() for _ in range(100)]
        for _ in range(30):
            v = v[4:] + [word() for _ in range(4)]
            texts.append(" ".join(v))
    for _ in range(60):  # pairs at the limit
        v = [word() for _ in range(60)]
        n = r.randint(5, 12)
        texts += [" ".join(v), " ".join(v[n:] + [word() for _ in range(n)])]
    r.shuffle(texts)
    docs = [(i * 3 - 100, t) for i, t in enumerate(texts)]
    assert got(op4_near_dup(spark, put_docs(docs))) == expected(docs)


def test_odd_rows(spark, put_docs):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "É é"), (8, "é é"), (9, "x" * 600_000),
            (10, "x" * 600_000 + " "), (11, "w " * 200_000), (12, "w W w w w"), (13, "one two three four five six"),
            (13, "one two three four five six"), (14, "a b"), (14, "q r")]
    assert got(op4_near_dup(spark, put_docs(docs))) == expected(docs)
    rows = op4_near_dup(spark, put_docs([(None, "a b"), (3, "a b"), (None, "lone")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(3, 3, True)]
    assert sorted(str(r["component_id"]) for r in rows if not r["doc_id"]) == ["3", "None"]
    assert op4_near_dup(spark, put_docs([])).collect() == []


def test_word_hashes_long_words_and_spans():
    text = (b"abc DEF " * 60_000) + b"z" * 300_000 + b" end"
    whole = shingles(np.frombuffer(text, dtype=np.uint8))
    assert len(whole) == len(set_of(text.decode()))
    assert len(shingles(np.frombuffer(b"a\xc2\xa0b c", dtype=np.uint8))) == 1


def test_registers_merge_and_estimate():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:2000], r.integers(0, 1 << 63, 500, dtype=np.uint64))))
    both = np.union1d(a, b)
    assert (np.maximum(sketch(a), sketch(b)) == sketch(both)).all()
    alike, n = [], 1000
    for j in (0.3, 0.5, 0.75, 0.9):
        k = round(2 * n * j / (1 + j))
        pool = [np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)) for _ in range(200)]
        one = np.array([sketch(p[:n]) for p in pool])
        two = np.array([sketch(p[n - k: 2 * n - k]) for p in pool])
        assert (one == two).mean() == pytest.approx(j, abs=0.02)
        alike.append(may_be_alike(one, two, np.full(200, float(n)), np.full(200, float(n))).mean())
    assert alike[0] < 0.02 and alike[2] == alike[3] == 1 and M >= near_dup.BANDS * near_dup.ROWS


def test_blocks_find_what_one_block_finds(spark, put_docs, monkeypatch):
    """Buckets of unlike texts that share a passage, in cells of a few classes and in one."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(90)]
    docs = [(i, " ".join(passage + [word() for _ in range(r.randint(20, 50))])) for i in range(300)]
    want = expected(docs)
    assert got(op4_near_dup(spark, put_docs(docs))) == want
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    assert got(op4_near_dup(spark, put_docs(docs))) == want
