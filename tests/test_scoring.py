"""Lexicon scorers: edge rows, strategy equivalence, properties."""
from pyspark.sql import functions as F

from tonekit.functions.classes import EDGES_ORDINAL, agreement, polarity_class
from tonekit.operators.scoring import score_sentences
from tonekit.operators.sentences import explode_sentences


def sent(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, rank_sentence int, sentence string")


def test_negation_flips_and_damps(spark):
    from tonekit.sources.lexicon import LEXICON_SCHEMA
    from decimal import Decimal
    lex = spark.createDataFrame([("good", Decimal("1.9"), None, None)], LEXICON_SCHEMA)
    df = sent(spark, ["not very good", "very good"])
    got = {r.id: r.compound for r in score_sentences(df, lex, negation=True).collect()}
    s = -1.406
    assert got[0] == round(s / (s * s + 15) ** 0.5, 4)
    assert got[1] == round(1.9 / (1.9 * 1.9 + 15) ** 0.5, 4)


def test_no_tokens_scores_zero(spark, lexicon):
    r = score_sentences(sent(spark, ["...", ""]), lexicon).collect()
    for row in r:
        assert (row.compound, row.neg, row.neu, row.pos, row.polarity, row.subjectivity, row.ordinal) == (0, 0, 0, 0, 0, 0, 2)


def test_shares_and_compound(spark, lexicon):
    # for: 1.9 (pos 2.9), was: -1.1 (neg 2.1), zzz: neutral 1 -> total 6.0
    r = score_sentences(sent(spark, ["for was zzz"]), lexicon).first()
    assert (r.pos, r.neg, r.neu) == (round(2.9 / 6, 3), round(2.1 / 6, 3), round(1 / 6, 3))
    assert r.compound == round(0.8 / (0.64 + 15) ** 0.5, 4)
    assert abs(r.polarity - (-0.3)) < 1e-12 and abs(r.subjectivity - 0.6) < 1e-12


def test_strategies_agree(spark, lexicon):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = explode_sentences(docs, "doc_id", "text", 1)
    for neg in (False, True):
        a = score_sentences(s, lexicon, negation=neg, strategy="inline")
        b = score_sentences(s, lexicon, negation=neg, strategy="exploded")
        assert a.count() == b.count()
        assert a.exceptAll(b).count() == 0


def test_scored_plan_is_narrow(spark, lexicon):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = score_sentences(explode_sentences(docs, "doc_id", "text", 1), lexicon)
    plan = scored.where(F.col("compound") != 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan          # no shuffle
    assert plan.count("regexp_extract_all(lower(") == 1  # the score filter does not re-run the scoring


def test_classes_edges(spark):
    vals = [-1.01, -1.0, -0.00001, 0.0, 0.00001, 0.00002, 1.0, 1.01, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(polarity_class("x")).collect()]
    n, z, p = "negative", "neutral", "positive"
    assert got == [None, n, n, z, z, p, p, None, None]
    ords = spark.createDataFrame([(v,) for v in range(5)], "x int")
    assert [r[0] for r in ords.select(polarity_class("x", EDGES_ORDINAL)).collect()] == [n, n, z, p, p]


def test_agreement_nulls(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), (None, None), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(agreement("a", "b")).collect()] == ["agreement"] + ["disagreement"] * 3


def _vocab_lexicon(spark, n_words):
    """A lexicon over the corpus vocabulary with values from a fixed rule (test input only)."""
    from tonekit.functions.text import word_tokens
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = (docs.select(F.explode(word_tokens("text")).alias("word")).groupBy("word").count()
                 .orderBy(F.desc("count"), "word").limit(n_words))
    h = F.abs(F.xxhash64("word"))
    return words.select(
        "word",
        ((h % 41 - 20) / 10).cast("decimal(18,4)").alias("valence"),
        F.when(h % 3 == 0, ((h % 21 - 10) / 10)).cast("decimal(18,4)").alias("polarity"),
        F.when(h % 3 == 0, ((h % 11) / 10)).cast("decimal(18,4)").alias("subjectivity"))


def _shape(df):
    """Operators of the executed plan, without their expressions."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()]


def test_one_plan_for_any_lexicon(spark, lexicon):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = explode_sentences(docs, "doc_id", "text", 1)
    lex = _vocab_lexicon(spark, 5000)
    assert lex.count() > 3000
    few, many = score_sentences(s, lexicon), score_sentences(s, lex)
    assert _shape(few) == _shape(many) and "Exchange" not in _shape(many)
    exploded = score_sentences(s, lex, strategy="exploded")
    assert many.count() == exploded.count() and many.exceptAll(exploded).count() == 0


def test_lexicon_beyond_the_plan_is_cut_to_the_corpus(spark, monkeypatch):
    from tonekit.operators import scoring
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    s = explode_sentences(docs, "doc_id", "text", 1)
    lex = _vocab_lexicon(spark, 3000)
    want = score_sentences(s, lex, modifiers=True, strategy="inline")
    monkeypatch.setattr(scoring, "MAX_PLAN_WORDS", 2500)   # the lexicon is larger, its words in the texts are fewer
    assert "Exchange" not in _shape(score_sentences(s, lex, modifiers=True))
    monkeypatch.setattr(scoring, "MAX_PLAN_WORDS", 10)     # both are larger: tokens are joined
    got = score_sentences(s, lex, modifiers=True)
    assert "Exchange" in " ".join(_shape(got))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_modifiers_by_hand(spark):
    """Boosters, dampers and a negator against plain arithmetic, both strategies."""
    from decimal import Decimal
    from tonekit.sources.lexicon import BOOST, BOOSTERS, DAMPERS, DECAY, LEXICON_SCHEMA, NEGATION_FACTOR, NEGATORS
    import random
    r = random.Random(6)
    values = {"good": Decimal("1.9"), "bad": Decimal("-1.3"), "flat": Decimal("0.1"), BOOSTERS[0]: Decimal("0.7")}
    lex = spark.createDataFrame([(w, v, None, None) for w, v in values.items()], LEXICON_SCHEMA)
    vocabulary = [*values, *BOOSTERS, *DAMPERS, *NEGATORS, "word", "other"]
    texts = ["", "word"] + [" ".join(r.choices(vocabulary, k=r.randint(1, 14))) for _ in range(200)]
    want = {}
    for i, t in enumerate(texts):
        toks, total = t.split(), Decimal(0)
        for k, w in enumerate(toks):
            if w not in values:
                continue
            v, sign = values[w], (values[w] > 0) - (values[w] < 0)
            for d in (1, 2, 3):
                if k - d >= 0:
                    v += sign * BOOST * DECAY[d - 1] * ((toks[k - d] in BOOSTERS) - (toks[k - d] in DAMPERS))
            if any(x in NEGATORS for x in toks[max(0, k - 3):k]):
                v *= NEGATION_FACTOR
            total += v
        x = float(total)
        want[i] = x / (x * x + 15) ** 0.5
    for strategy in ("inline", "exploded"):
        got = {x.id: x.compound for x in score_sentences(sent(spark, texts), lex, modifiers=True, strategy=strategy).collect()}
        assert all(abs(got[i] - want[i]) <= 0.000051 for i in want)


def test_strategies_agree_on_odd_rows(spark):
    rows = [(None, 0, "good bad"), (1, 0, "good"), (1, 0, "bad fine"), (1, 0, "bad fine"), (2, None, "fine"), (3, 0, None), (4, 0, "")]
    df = spark.createDataFrame(rows, "id long, rank_sentence int, sentence string")
    lex = spark.createDataFrame([("good", 0.29, 0.57, 0.1), ("bad", -1.15, None, None), ("bad", -0.3, 0.2, None),
                                 ("fine", 0.0001, -0.0029, 1.0), (None, 1.0, 1.0, 1.0)],
                                "word string, valence double, polarity double, subjectivity double")
    for kind in ({}, {"negation": True}, {"modifiers": True}):
        a, b = (score_sentences(df, lex, strategy=s, **kind) for s in ("inline", "exploded"))
        assert a.columns == b.columns and a.count() == b.count() == len(rows)
        assert a.exceptAll(b).count() == 0
    got = {(r.id, r.sentence): r for r in b.collect()}
    assert got[1, "good"].polarity == 0.57 and got[2, "fine"].polarity == -0.0029 and got[1, "bad fine"].polarity == round(0.1971 / 2 + 1e-9, 4)
    assert (got[3, None].compound, got[3, None].ordinal) == (0.0, 2)
