"""N9 in the stage that reads the texts: sums by trigram table, and the sentence table's language per ``(id, rank_sentence)``."""

import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tonekit.operators import language, trigram_sums
from tonekit.operators.language import build_profiles, detect_language, language_model
from tonekit.plans.sentiment import sentiment_table

WORDS = {"en": "the house with this and that", "de": "das haus für über mit größe", "el": "το σπίτι με αυτό και"}


def _trigrams(word):
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(word))]


@pytest.mark.parametrize(("slice_cells", "direct_cells"), [(1 << 19, 1 << 24), (12, 1 << 24), (12, 0)])
def test_sums_of_slices_and_both_lookups(monkeypatch, slice_cells, direct_cells):
    """Whatever the slices and the lookup: each trigram once, also of words longer than a slice and outside of ASCII."""
    monkeypatch.setattr(trigram_sums, "SLICE_CELLS", slice_cells)
    monkeypatch.setattr(trigram_sums, "DIRECT_CELLS", direct_cells)
    rnd = random.Random(5)
    vocabulary = ["a", "ab", "haus", "über", "größe", "σπίτι", "𝒜𝒷", "x" * 40, "é" * 30, "日本語"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(9))) for _ in range(60)]
    known = sorted({t for w in vocabulary[:7] for t in _trigrams(w)})
    weights = np.array([[rnd.random() for _ in range(3)] for _ in known])
    weight_of = dict(zip(known, weights))
    summed = trigram_sums.text_summer(trigram_sums.trigram_table([*known, "abcd"], np.vstack([weights, [[9.0] * 3]])))
    counts, sums = summed(pa.array([f" {t} " for t in texts])[3:])
    for k, text in enumerate(texts[3:]):
        tri = [t for w in text.split() for t in _trigrams(w)]
        assert counts[k] == len(tri)
        assert np.allclose(sums[:, k], sum((weight_of.get(t, np.zeros(3)) for t in tri), np.zeros(3)))
    assert [len(x) for x in summed(pa.array([], pa.string()))] == [0, 3]


def test_workers_need_no_copy_of_the_package():
    """What is broadcast holds plain arrays, as Spark pickles it by reference; the function itself is sent by value."""
    assert b"tonekit" not in pickle.dumps(trigram_sums.trigram_table(["abc"], np.array([[1.0]])))
    assert b"_rows_of" in cloudpickle.dumps(trigram_sums.text_summer)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture()
def profiles(spark):
    return build_profiles(_docs(spark, [(i, text, lang) for i, (lang, text) in enumerate(WORDS.items())])).localCheckpoint()


def _table(df, lexicon, profiles):
    return sentiment_table(df, "doc_id", "text", lexicon, 1, keep=["lang"], profiles=profiles)


def test_sentences_are_not_shuffled_for_their_language(spark, lexicon, profiles):
    """One stage from the texts to the scored rows; a word of the texts costs no row of a shuffle or a stored table."""
    docs = _docs(spark, [(i, f"The house {chr(97 + i % 26) * (i % 7 + 1)}. Das haus. 12!", "en") for i in range(50)])
    out = _table(docs, lexicon, profiles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    got = {(r.id, r.rank_sentence): (r.sentence, r.language) for r in out.collect()}
    assert len(got) == 150
    assert {got[i, 1] for i in range(50)} == {("Das haus.", "de")} and {got[i, 2][1] for i in range(50)} == {"no features in text"}


def _expected(rows, profiles):
    """The languages by a plain count: sentences that share an id and a rank are one text; none without an id."""
    counts = {(r.lang, r.tri): r.n for r in profiles.collect()}
    langs = sorted({lang for lang, _ in counts})
    vocabulary = len({t for _, t in counts})
    total = {x: sum(n for (lang, _), n in counts.items() if lang == x) for x in langs}
    texts, out = {}, []
    for i, text, _ in rows:
        for rank, s in enumerate(re.split(r"(?<=[.])\s+", text)):
            texts.setdefault((i, rank), []).append(s)
    for (i, rank), sentences in texts.items():
        tri = [t for s in sentences for w in re.findall(r"[^\W\d_]+", s.lower()) for t in _trigrams(w)]
        score = {x: sum(np.log(counts.get((x, t), 0) + 1) for t in tri) - len(tri) * np.log(total[x] + vocabulary) for x in langs}
        best = max(langs, key=lambda x: (score[x], x)) if tri else "no features in text"
        out += [(i, rank, s, None if i is None else best) for s in sentences]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", ["as they are", "many repeated ids", "profile too large for a task"])
def test_language_of_repeated_and_null_ids(spark, lexicon, profiles, monkeypatch, limits):
    if limits == "many repeated ids":
        monkeypatch.setattr("tonekit.plans.sentiment.is_small", lambda df: False)
    if limits == "profile too large for a task":
        monkeypatch.setattr(language, "TABLE_MAX_BYTES", 0)
    rows = [(1, "The house. Das haus über.", "en"), (2, "This house and that house.", "en"), (2, "Haus.", "de"), (2, "Mit größe für.", "de"),
            (3, "Das haus. 12.", "de"), (3, "Das haus. The.", None), (None, "The house.", "en"), (None, "Das haus.", None), (4, "το σπίτι.", "el")]
    assert (language_model(profiles).sums is None) == (limits == "profile too large for a task")
    got = [(r.id, r.rank_sentence, r.sentence, r.language) for r in _table(_docs(spark, rows), lexicon, profiles).collect()]
    assert sorted(got, key=str) == _expected(rows, profiles)


def test_detect_language_sums_up_rows_of_one_key(spark, profiles):
    """One row per key, null keys too; a null text has no words."""
    df = spark.createDataFrame([(1, 0, "this house"), (1, 0, "haus"), (None, 0, "das haus"), (None, 0, "über"), (2, 0, None), (3, 1, "12")],
                               "id long, rank_sentence int, sentence string")
    got = {(r.id, r.rank_sentence): r.language for r in detect_language(df, profiles).collect()}
    assert got == {(1, 0): "en", (None, 0): "de", (2, 0): "no features in text", (3, 1): "no features in text"}
    assert detect_language(df.where(F.lit(False)), profiles).count() == 0
