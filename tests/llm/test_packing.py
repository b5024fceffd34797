import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tonekit.llm import packing
from tonekit.llm.packing import op5_packing, pack_lengths, sequences


def ids_of(texts):
    found = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 2] for e in found]


def best(items, size):
    """The least number of bins, by trying all (a few items)."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    n = len(items)
    for k in range(len(rest), -1, -1):
        for c in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in c) <= size:
                n = min(n, 1 + best([x for i, x in enumerate(rest) if i not in c], size))
    return n


def least_bins(counts, size):
    """Martello and Toth's second lower bound."""
    most = 0
    for small in range(size // 2 + 1):
        alone = sum(n for w, n in counts.items() if w > size - small)
        big = {w: n for w, n in counts.items() if size / 2 < w <= size - small}
        rest = sum(w * n for w, n in counts.items() if small <= w <= size / 2)
        over = rest - sum((size - w) * n for w, n in big.items())
        most = max(most, alone + sum(big.values()) + max(0, -(-over // size)))
    return most


def test_pack_lengths_small_instances():
    r, optimal = random.Random(5), 0
    for _ in range(150):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 8))]
        counts = {w: items.count(w) for w in items}
        bins = pack_lengths(counts, 20)
        placed = defaultdict(int)
        for times, lengths in bins:
            assert times > 0 and sum(lengths) <= 20
            for w in lengths:
                placed[w] += times
        assert dict(placed) == counts
        assert sum(t for t, _ in bins) <= best(items, 20) + 1
        optimal += sum(t for t, _ in bins) == best(items, 20)
    assert optimal >= 145


def test_reduction_alone_is_optimal(monkeypatch):
    """Where the reduction fixes everything, the number of bins is the least."""
    monkeypatch.setattr(packing, "_best_fit", lambda bins, items, size: (bins, items))
    r, whole = random.Random(6), 0
    for _ in range(300):
        items = [r.randint(4, 20) for _ in range(r.randint(1, 7))]
        bins, rest = pack_lengths({w: items.count(w) for w in items}, 20)
        left = [w for w, n in rest.items() for _ in range(n)]
        whole += not left
        assert sum(t for t, _ in bins) + best(left, 20) == best(items, 20)
    assert whole > 100


def test_pack_lengths_large_counts():
    r = random.Random(7)
    counts = {w: r.randint(1, 10 ** 9) for w in range(1, 1025)}
    bins = pack_lengths(counts)
    assert sum(t * len(x) for t, x in bins) == sum(counts.values())
    assert sum(t for t, _ in bins) <= 1.005 * least_bins(counts, 1024)
    assert len(bins) < 50_000


def check(got, texts):
    by_seq, ids = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        ids[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for (doc, _), own in zip(texts, ids_of([t for _, t in texts])):
        n = len(own)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        assert sorted(ids[doc]) == [(k, a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes()))
                                    for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return len(by_seq)


def test_op5(spark, sf_dir, rows):
    texts = rows("documents", "doc_id, text")
    got = op5_packing(spark, sf_dir).collect()
    total = sum(r["length"] for r in got)
    assert check(got, texts) <= 1.03 * total / 1024 + 1


def test_op5_many_buckets_and_odd_rows(spark, sf_dir, rows, put_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    check(op5_packing(spark, sf_dir).collect(), rows("documents", "doc_id, text"))
    texts = list(enumerate(["", None, "x " * 5000, "a b", "a b", "  "]))
    check(op5_packing(spark, put_docs(texts)).collect(), texts)
    same = op5_packing(spark, put_docs([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert len(same) == 4 and len({(r["sequence_id"], r["offset"]) for r in same}) == 4
    assert op5_packing(spark, put_docs([])).collect() == []


def test_sequences_hold_the_ids(spark, sf_dir, rows):
    own = dict(zip([d for d, _ in rows("documents", "doc_id, text")], ids_of([t for _, t in rows("documents", "doc_id, text")])))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in sequences(docs, P.path("byte_bpe_50k.json")).collect():
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert r["n_tokens"] == len(ids) <= 1024
        for p in r["parts"]:
            have = own[p["doc_id"]]
            cut = [0, *range(len(have) % 1024 or 1024, len(have) + 1, 1024)]
            a = cut[p["piece"]]
            assert ids[p["offset"]: p["offset"] + p["length"]] == have[a: a + p["length"]]
