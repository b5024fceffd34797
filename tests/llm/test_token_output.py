import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tonekit.llm.encoder import UnitEncoder, encoder
from tonekit.llm.huffman import EVERY, Code, code_lengths
from tonekit.llm.token_output import _tokenizer, op3_token_output

ODD = ["", " ", "a  b", "\n\n x\ty  ", "it's  we'll x  y", "<|endoftext|> a<|endoftext|>b  <|startoftext|>",
       "é ́x", "ΑΣ ΣΑ", "x" * 500, "a\x1cb \x85c", "　全角 テスト", "a \n b\r\n\r\nc ", "12 345 6½", None]


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_units_give_the_ids_of_the_whole_text(name, drops):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(" \n\tab$%!-:'sé,.1<|> ́Σ") for _ in range(60)) for _ in range(2000)]
    got = UnitEncoder(P.path(name), drops).encode(texts)
    want = Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in want]


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths():
    r = np.random.default_rng(3)
    for n in (2, 3, 17, 300):
        counts = r.integers(0, 1000, n)
        counts[:2] = 5, 9
        lengths = code_lengths(counts, 18)
        assert sum(2.0 ** -int(b) for b in lengths if b) == 1
        assert int((counts * lengths).sum()) == huffman_cost(counts.tolist())  # the limit does not bind
    steep = np.array([3 ** k for k in range(30)])
    assert code_lengths(steep, 18).max() == 18 and sum(2.0 ** -int(b) for b in code_lengths(steep, 18)) == 1
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    assert code_lengths(np.zeros(0)).tolist() == []


def test_code_round_trip():
    r = np.random.default_rng(4)
    ids = (r.zipf(1.3, 50_000) % 3000).astype("<u4")
    code = Code(code_lengths(np.bincount(ids)))
    data, checks = code.encode(ids)
    size = np.full(len(checks), EVERY)
    size[-1] = len(ids) - EVERY * (len(checks) - 1)
    assert (Code(code.lengths.astype(np.uint8)).decode(data, checks, size) == ids).all()
    k = len(checks) // 2  # one segment alone, from its checkpoint
    assert (code.decode(data, checks[k:k + 1], size[k:k + 1]) == ids[k * EVERY:(k + 1) * EVERY]).all()


def expected(texts):
    found = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch(
        [t or "" for _, t in texts], add_special_tokens=False)
    out, start = [], 0
    for (doc, _), e in sorted(zip(texts, found), key=lambda x: x[0][0]):
        ids = np.array([*e.ids, 1], dtype="<u4").tobytes()
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_op3_against_tokenizer(spark, sf_dir, rows):
    assert sorted(map(tuple, op3_token_output(spark, sf_dir).collect())) == expected(rows("documents", "doc_id, text"))


def test_op3_many_ranges(spark, sf_dir, rows, monkeypatch):
    monkeypatch.setattr("tonekit.llm.token_output.RANGE_IDS", 9_000)
    monkeypatch.setattr("tonekit.llm.token_output.BLOCK_IDS", 2_000)
    assert sorted(map(tuple, op3_token_output(spark, sf_dir).collect())) == expected(rows("documents", "doc_id, text"))


def test_op3_odd_rows(spark, put_docs):
    texts = list(enumerate(ODD + ["long " * 30_000]))
    assert sorted(map(tuple, op3_token_output(spark, put_docs(texts)).collect())) == expected(texts)
    same = [(5, "a b"), (5, "a b"), (None, "c"), (5, None)]
    got = op3_token_output(spark, put_docs(same)).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in got] == [(None, 2, 0), (5, 1, 2), (5, 3, 3), (5, 3, 6)]
    assert op3_token_output(spark, put_docs([])).collect() == []


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_units_give_the_tokenizers_ids(name, drops_space):
    """Fuzzed texts with white space of all kinds, added tokens and letters that change in lower case."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tonekit.llm.encoder import UnitEncoder

    path = public_tokenizers.path(name)
    plain, r = Tokenizer.from_file(path), random.Random(31)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    odd = ["İ|", "a İ, b", "Diyarbakırİ!", "end\n\n<|endoftext|>start", "x\u00a0<|endoftext|>", "\u2028<|endoftext|> y", "ẞ.", "ǅ!", "ﬁ;", "Σ,ς"]
    pieces = odd + added + [a.upper() for a in added] + [
        " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\u2028", "\u3000", "\r", "word", "Été", "über.", "I'm", "don’t", "123", "4,5", "—", "…",
        "İ", "ı", "e\u0301", "한국", "日本", "🙂", "don't!", "(a)", "|", "!", ";x", "A-Z", "_", "a_b", "'s", "'S", "straße,", "ÑANDÚ!"]
    texts = odd + ["".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(20_000)]
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    mine = UnitEncoder(path, drops_space)
    got = [np.frombuffer(b, "<u4").tolist() for i in range(0, len(texts), 500) for b in mine.encode(texts[i:i + 500])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_arrays_give_the_tokenizers_ids(name, drops_space):
    """Slices with nulls, empty texts and texts that go to the tokenizer whole, each with its tail."""
    plain, r = Tokenizer.from_file(P.path(name)), random.Random(7)
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "word,", "Été.", "über", "İ|", "½,", "日本", "a", "..."]
    texts = ODD + ["".join(r.choices(pieces, k=r.randint(0, 7))) for _ in range(3000)] + [None, "", "x"]
    want = [np.array([*e.ids, 9], dtype="<u4").tobytes()
            for e in plain.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    mine, whole = UnitEncoder(P.path(name), drops_space), pa.array(["unread", *texts], pa.string())
    tail = np.array([9], dtype="<u4").tobytes()
    assert [b for i in range(0, len(texts), 700) for b in mine.encode_array(whole.slice(1 + i, 700), tail).to_pylist()] == want
    for none in ([], [None, ""]):
        assert mine.encode_array(pa.array(none, pa.string())).to_pylist() == [b""] * len(none)


def test_a_word_beyond_the_cache_is_tokenized_once_an_array(monkeypatch):
    """Rare words that no cache has room for cost a call for each 8 MB of text, not for each few texts or word."""
    monkeypatch.setattr("tonekit.llm.encoder.CACHE_UNITS", 0)
    calls = []
    monkeypatch.setattr(UnitEncoder, "_word", lambda self, unit, f=UnitEncoder._word: calls.append(unit) or f(self, unit))
    path = P.path("word_bpe_49k.json")
    encoder.cache_clear()
    texts = [f"rare {'abcdefghij'[i % 10]}word, rare. words" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    encoder(path, True)
    calls.clear()
    got = [b for out in _tokenizer(path, True, 1)([batch]) for b in out.column(2).to_pylist()]
    encoder.cache_clear()
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array([*e.ids, 1], dtype="<u4").tobytes() for e in want]
    assert len(calls) == 12 and len(set(calls)) == 12
