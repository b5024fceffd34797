"""Column expressions on inline edge rows (FIXTURES section 4)."""
import datetime as dt

from pyspark.sql import functions as F

from tonekit.functions import text as T
from tonekit.functions.html import element_text, first_match
from tonekit.functions.numeric import np_round
from tonekit.operators.sentences import explode_sentences, is_noise, split_sentences


def col_values(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_strip_brackets_greedy(spark):
    assert col_values(spark, ["x[a]y[b]z"], T.strip_brackets) == ["xz"]


def test_space_after_dot(spark):
    assert col_values(spark, ["U.S. ok."], T.space_after_dot) == ["U. S.  ok. "]


def test_strip_all_whitespace(spark):
    assert col_values(spark, ["\t a \n", " b "], T.strip) == ["a", "b"]


def test_clean_post(spark):
    assert col_values(spark, ["x http://a #b @c"], T.clean_post) == ["x"]


def test_range_parts(spark):
    r = "January 20, 2017 – Incumbent"
    start = col_values(spark, [r], lambda c: F.year(T.parse_date(T.split_part(c, "–", 1))))
    end = col_values(spark, [r], lambda c: T.open_end_year(T.split_part(c, "–", 2)))
    assert start == [2017] and end == [2021]


def test_parse_date_layouts(spark):
    got = col_values(spark, ["January 20, 1961", "1961-01-20", "1961-01-20 00:00:00", "1961", "junk"], T.parse_date)
    d = dt.date(1961, 1, 20)
    assert got == [d, d, d, dt.date(1961, 1, 1), None]


def test_default_if_blank(spark):
    got = col_values(spark, [None, "", "  ", "abc"], lambda c: T.default_if_blank(c, "No info available"))
    assert got == ["No info available"] * 3 + ["abc"]


def test_np_round_half_even(spark):
    got = col_values(spark, [0.25, 0.35, -0.04], lambda c: np_round(c, 1), "x double")
    assert got == [0.2, 0.4, 0.0]
    assert str(got[2]) == "0.0"  # no negative zero


def test_sentence_split(spark):
    got = col_values(spark, ['He said "no." Then U.S. fell! Ok?'], split_sentences)
    assert got == [['He said "no."', "Then U.S.", "fell!", "Ok?"]]


def test_noise(spark):
    assert col_values(spark, ["(Applause.)", "(a) b", ".x"], is_noise) == [True, False, True]


def test_rank_after_noise_filter(spark):
    df = spark.createDataFrame([(1, "A. (Applause.) B.")], "id long, text string")
    rows = explode_sentences(df, "id", "text", 1).orderBy("rank_sentence").collect()
    assert [(r.rank_sentence, r.sentence) for r in rows] == [(0, "A."), (1, "B.")]


def test_whole_text_mode_and_null(spark):
    df = spark.createDataFrame([(1, "A. (Applause.) B."), (2, None)], "id long, text string")
    rows = explode_sentences(df, "id", "text", 0).collect()
    assert [(r.id, r.rank_sentence, r.sentence) for r in rows] == [(1, 0, "A. (Applause.) B.")]


def test_word_tokens(spark):
    assert col_values(spark, ["Élan, für ÜBER-da."], T.word_tokens) == [["élan", "für", "über", "da"]]


def test_element_text_and_fallback(spark):
    html = '<html><title>T &amp; U</title><article><h1>H</h1><p>Body</p></article><div class="ad x">Ad</div></html>'
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(element_text("html", "title").alias("t"), element_text("html", "div", "ad").alias("ad"),
                  element_text("html", "h2").alias("missing"),
                  first_match("html", [("div", "transcript-inner"), ("article", None)]).alias("body")).first()
    assert (r.t, r.ad, r.missing, r.body) == ("T & U", "Ad", None, "HBody")


def test_recode_strict_boundary(spark):
    import datetime as dt
    from tonekit.operators.clean import recode
    rows = [("G", dt.date(1892, 12, 31)), ("G", dt.date(1893, 1, 1)), ("G", dt.date(1893, 1, 2)), ("H", dt.date(1800, 1, 1))]
    df = spark.createDataFrame(rows, "name string, d date")
    cut = F.lit(dt.date(1893, 1, 1))
    out = recode(df, "name", [((F.col("name") == "G") & (F.col("d") < cut), "G 1"),
                              ((F.col("name") == "G") & (F.col("d") > cut), "G 2")])
    assert [r.name for r in out.orderBy("d").collect()] == ["H", "G 1", "G", "G 2"]


def test_normalise_names_all_string_columns(spark):
    from tonekit.operators.clean import normalise_names
    df = spark.createDataFrame([("Ann Example", "Ann Example Jr", 1)], "a string, b string, n int")
    r = normalise_names(df, {"Ann Example": "Ann Q. Example"}).first()
    assert (r.a, r.b, r.n) == ("Ann Q. Example", "Ann Q. Example Jr", 1)


def test_panel_index_grid(spark):
    from tonekit.operators.windows import panel_index
    df = spark.createDataFrame([(i, 10 - i) for i in range(7)], "id long, d int")
    rows = {r.id: (r.panel, r.panel_row, r.panel_col) for r in panel_index(df, "id", ["d", "id"]).collect()}
    assert rows[6] == (0, 0, 0) and rows[3] == (3, 1, 0) and rows[0] == (6, 2, 0)


def test_free_form_dates(spark):
    import datetime
    day = datetime.date(1885, 3, 4)
    texts = {"4th of March, 1885": day, "Mar. 4 1885": day, "4.3.1885": day, "March 4, 1885": day, "1885-03-04": day, "3/4/1885": day,
             "the 4th Mar 1885 ": day, "1885 March 4": day, "Wednesday, 4 March 1885": day, "18850304": day, "1885-3-4T10:11:12Z": day,
             "March 4, 1885 at 10:11 pm": day, "13/4/1885": datetime.date(1885, 4, 13), "4/13/1885": datetime.date(1885, 4, 13),
             "March 1885": datetime.date(1885, 3, 1), "1885": datetime.date(1885, 1, 1), "4 Mar '85": datetime.date(1985, 3, 4),
             "Sept 5, 68": datetime.date(2068, 9, 5), "February 30, 1999": None, "31.4.1999": None, "junk": None, "": None, None: None,
             "March": None, "March 4": None, "4": None, "1 2": None, "12 monkeys 1995": None, "1885-03-04-05": None, "99999": None,
             "March 4, 1885 and more": None, "Mai 4 1885": None, "10:11:12": None}
    got = col_values(spark, list(texts), T.parse_date)
    assert dict(zip(texts, got)) == texts
