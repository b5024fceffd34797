"""Learned sentence boundaries: statistics by hand-made corpora, the split on known hard cases."""
import random

from pyspark.sql import functions as F

from tonekit.operators.boundaries import boundary_statistics, explode_learned, known_words
from tonekit.session import materialize

WORDS = ("house home garden old late work today city evening people doctor rain door empty left came went saw paid knew "
         "behind under open said stood garden man woman child road river bridge stone light").split()


def corpus():
    """Random sentences: any word may end one, titles stand before names, every other sentence begins with "The"."""
    r, texts = random.Random(12), []
    for _ in range(150):
        sentences = []
        for _ in range(8):
            words = r.choices(WORDS, k=r.randint(4, 9))
            if r.random() < 0.4:
                words[r.randint(1, len(words) - 2):0] = [r.choice(["Dr.", "Mr.", "Prof."]), r.choice(["Smith", "Jones", "Adler"])]
            first = "The" if r.random() < 0.5 else words.pop(0).capitalize()
            sentences.append(" ".join([first, *words]) + r.choice([".", ".", ".", "!", '."']))
        texts.append(" ".join(sentences))
    return texts + [None, "", "..."]


def test_statistics_and_split(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
    stats = materialize(boundary_statistics(docs))
    short, starters = known_words(stats)
    assert set(short) == {"dr", "mr", "prof"} and set(starters) == {"the"}
    texts = {
        "Dr. Smith came. He left.": ["Dr. Smith came.", "He left."],
        "He met Dr. The house was open.": ["He met Dr.", "The house was open."],
        "Mr. J. R. Smith paid 3.14 today. It rained!": ["Mr. J. R. Smith paid 3.14 today.", "It rained!"],
        "Er kam z. B. als 4. von acht nach Haus. Dann ging er.": ["Er kam z. B. als 4. von acht nach Haus.", "Dann ging er."],
        "Wait... What? Yes (Dr. Who). Done": ["Wait...", "What?", "Yes (Dr. Who).", "Done"],
        "It was room 4. Next came 5.": ["It was room 4.", "Next came 5."],
        " \n ": [], "": [], None: [], "(Applause.) .x": [], "Mr.": ["Mr."],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(explode_learned(df, "doc_id", "text", stats).collect()):
        got.setdefault(r.id, []).append(r.sentence)
        assert len(got[r.id]) == r.rank_sentence + 1
    assert {t: got.get(i, []) for i, t in enumerate(texts)} == texts


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    stats = materialize(boundary_statistics(docs))
    assert stats.collect() == []
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.")], "doc_id long, text string")
    assert [r.sentence for r in explode_learned(df, "doc_id", "text", stats).orderBy("rank_sentence").collect()] == ["Ab cd.", "Ef gh."]


def test_patterns_run_on_distinct_pairs_of_tokens(spark):
    """Counting comes before the patterns that take tokens apart: none of them stands below the first aggregate."""
    from tonekit.operators.boundaries import raw_tokens
    df = spark.createDataFrame([(1, "\u00a0 \"Dr. Ab (c.) d.. \u2003"), (2, " "), (3, "x.")], "doc_id long, text string")
    rows = df.select("doc_id", raw_tokens(F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert [[(p.raw, p.before) for p in r.t] for r in rows] == [
        [('"dr.', None), ("ab", '"dr.'), ("(c.)", None), ("d..", "(c.)")], [("", None)], [("x.", None)]]
    plan = df.select(raw_tokens(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^.]" not in plan


def test_white_space_of_any_kind_at_the_ends_of_sentences(spark):
    df = spark.createDataFrame([(1, "\u00a0Ab cd. \u3000 Ef gh.\u2003\n")], "doc_id long, text string")
    stats = spark.createDataFrame([], "word string, kind string, score double")
    assert [r.sentence for r in explode_learned(df, "doc_id", "text", stats).orderBy("rank_sentence").collect()] == ["Ab cd.", "Ef gh."]
