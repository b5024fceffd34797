"""Generated texts: the Spark sentence splitter, noise filter and tokenizer against plain Python."""
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tonekit.functions.text import word_tokens
from tonekit.operators.sentences import explode_sentences

# Same rules as tonekit, written directly in Python.
SENT = re.compile(r"""([.!?]+["')\]]*)[ \t\n\x0b\f\r]+""")
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
NOISE = re.compile(r"\(.*\)$|\.")
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def py_sentences(text):
    parts = [p.strip(WS) for p in SENT.sub(lambda m: m.group(1) + "\x1f", text).split("\x1f")]
    return [p for p in parts if p and not NOISE.match(p)]


ALPHABET = "abcXYZ éÜçñ .!?\"')]( \n\t12,;"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=80), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_sentences_match_python(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, text string")
    got = {}
    for r in explode_sentences(df, "id", "text", 1).collect():
        got.setdefault(r.id, []).append((r.rank_sentence, r.sentence))
    for i, text in enumerate(batch):
        want = list(enumerate(py_sentences(text)))
        assert sorted(got.get(i, [])) == want, (text, got.get(i), want)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_tokens_match_python(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, text string")
    got = {r.id: r.t for r in df.select("id", word_tokens("text").alias("t")).collect()}
    for i, text in enumerate(batch):
        assert got[i] == LETTERS.findall(text.lower()), text
