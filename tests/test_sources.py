"""Sources: CSV dialect round trip, HTML tables, token maps, language id, streaming."""
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tonekit.functions.text import strip_brackets
from tonekit.operators.clean import clean_names
from tonekit.operators.language import build_profiles, detect_language
from tonekit.operators.tokens_map import tokens_to_map
from tonekit.sources.csv import read_corpus_csv, write_corpus_csv
from tonekit.sources.html_table import html_table, table_to_columns

TABLE = ('<table><tr><th>President[a]</th><th>Party[b]</th></tr><tr><td>A &amp; B[1]</td><td>X</td></tr>'
         '<tr><td>C</td><td>Y</td></tr></table>')


def test_csv_round_trip(spark):
    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])
    rows = [(1, "it's; \n two"), (2, ""), (3, None), (4, "'q'")]
    df = spark.createDataFrame(rows, schema)
    path = tempfile.mkdtemp(prefix="tonekit-csv-") + "/out"
    write_corpus_csv(df, path, sep=";", quote="'")
    back = {r.id: r.text for r in read_corpus_csv(spark, path, schema, sep=";", quote="'").collect()}
    assert back == {1: "it's; \n two", 2: None, 3: None, 4: "'q'"}


def test_html_table_fixture(spark):
    df = spark.createDataFrame([(1, TABLE)], "page_id long, html string")
    long = html_table(df, "html", 0).withColumn("value", strip_brackets("value")) \
        .withColumn("header", strip_brackets("header"))
    wide = clean_names(table_to_columns(long, ["page_id"], ["President", "Party"]))
    got = sorted((r.President, r.Party) for r in wide.collect())
    assert got == [("A & B", "X"), ("C", "Y")]


def test_tokens_map_last_wins(spark):
    js = '[{"index":1,"word":"A","lemma":"a","pos":"X","ner":"O"},{"index":1,"word":"B","lemma":"b","pos":"Y","ner":"O"},' \
         '{"index":2,"word":"C","lemma":"c","pos":"Z","ner":"O"}]'
    df = spark.createDataFrame([(js,), ("[]",)], "j string")
    maps = [r[0] for r in df.select(tokens_to_map("j")).collect()]
    assert maps[0][1]["word"] == "B" and maps[0][2]["word"] == "C" and maps[1] == {}


def test_language_fallback_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prof = build_profiles(docs.where(F.col("doc_id") % 2 == 0))
    test = docs.where(F.col("doc_id") % 2 == 1).select(F.col("doc_id").alias("id"), F.lit(0).alias("rank_sentence"),
                                                       F.col("text").alias("sentence"), "lang")
    test = test.unionByName(spark.createDataFrame([(-1, 0, "123 ...", None)], test.schema))
    pred = detect_language(test, prof).join(test, ["id", "rank_sentence"])
    rows = pred.collect()
    assert [r.language for r in rows if r.id == -1] == ["no features in text"]
    scored = [r for r in rows if r.id != -1]
    assert sum(r.language == r.lang for r in scored) / len(scored) > 0.95


def test_streaming_matches_batch(spark, lexicon):
    from tonekit.operators.scoring import score_sentences
    from tonekit.operators.sentences import explode_sentences
    from tonekit.streaming.scoring_stream import start_scoring_stream
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = tempfile.mkdtemp(prefix="tonekit-stream-")
    q = start_scoring_stream(spark, f"{d}/documents*.parquet", docs.schema, lexicon, f"{base}/out",
                             f"{base}/ckpt", "doc_id", "text", 1)
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    want = score_sentences(explode_sentences(docs, "doc_id", "text", 1), lexicon)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_balanced_elements(spark):
    from tonekit.functions.html import element_text, first_match, link_targets
    pages = {
        1: ('<html><script>var s="<div class=\'x\'>no</div>";</script><div class="x">a<div>b</div>c &eacute;&#233;&#xE9;</div>'
            '<div class="x">second</div></html>', "abc ééé"),
        2: ("<p>none</p>", None),
        3: ("<div class=y>1</div><DIV id='a>b' class='w x'>2<div>3<div>4</div></div>5</DIV>6", "2345"),
        4: ("<!-- <div class='x'>no</div> --><div class=x>open <div>never closed", "open never closed"),
        5: ("<div class='xx x-y'>no</div><div class='x'></div><div class='x'>late</div>", ""),
        6: ("</div></div><div class='x'>&amp;lt; &notaname; &lt;b&gt; &copy &#0; &#x110000;</div>", "&lt; &notaname; <b> © \ufffd \ufffd"),
        7: (None, None),
        8: ("<div class='x'>" + "<div>n" * 3000 + "</div>" * 3000 + "end</div>out", "n" * 3000 + "end"),
    }
    df = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "page_id long, html string")
    got = {r.page_id: r.t for r in df.select("page_id", element_text("html", "div", "x").alias("t")).collect()}
    assert got == {k: want for k, (_, want) in pages.items()}
    body = {r.page_id: r.t for r in df.select("page_id", first_match("html", [("div", "x"), ("p", None)]).alias("t")).collect()}
    assert body[2] == "none" and body[5] is None and body[1] == "abc ééé"
    links = spark.createDataFrame([("""<a href="/a&amp;b">1</a><a class=x href='/c d'><A data-href="no" HREF=/e>""",)], "html string")
    assert links.select(link_targets("html")).first()[0] == ["/a&b", "/c d", "/e"]


def test_tables_nested_spans_and_open_cells(spark):
    html = ("<p>x</p><table><tr><th>skip</table><table id=2><thead><tr><th>A<th colspan=2>B</tr></thead><tr><td rowspan='3'>r</td>"
            "<td>1</td><td>2 <table><tr><td>in</td><td>ner</td></tr></table></td></tr><tr><td rowspan=9>3<td>4"
            "<tr><td colspan=\"2\">5</td></tr></table><table><tr><td>third</td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, "<table></table>"), (3, None), (4, "none")], "page_id long, html string")
    got = {(r.page_id, r.row, r.col): (r.header, r.value) for r in html_table(df, "html", 1).collect()}
    assert got == {(1, 1, 0): ("A", "r"), (1, 1, 1): ("B", "1"), (1, 1, 2): ("B", "2 inner"), (1, 2, 0): ("A", "r"),
                   (1, 2, 1): ("B", "3"), (1, 2, 2): ("B", "4"), (1, 3, 0): ("A", "r"), (1, 3, 1): ("B", "3"), (1, 3, 2): ("B", "5"),
                   (1, 3, 3): (None, "5")}
    inner = html_table(df, "html", 2, header=False).collect()
    assert [(r.row, r.col, r.header, r.value) for r in sorted(inner)] == [(0, 0, None, "in"), (0, 1, None, "ner")]
    assert html_table(df, "html", 9).collect() == []


def test_table_takes_one_sort_and_no_shuffle_of_dealt_pages(spark):
    """Spans wider than a batch, and a plan whose only exchange is the caller's."""
    rows = "".join(f"<tr><td>{i} &amp; &eacute;" for i in range(30))
    html = f"<table><tr><th>A<th>B</tr><tr><td rowspan=40>all {rows[4:]}</table>"
    df = spark.createDataFrame([(k, html) for k in range(40)] + [(None, None)], "page_id long, html string").repartition(3, "page_id")
    table = html_table(df, "html")
    got = {}
    for r in table.collect():
        got.setdefault(r.page_id, {})[r.row, r.col] = (r.header, r.value)
    want = {(i + 1, c): v for i in range(30) for c, v in ((0, ("A", "all")), (1, ("B", f"{i} & é")))}
    assert set(got) == set(range(40)) and all(v == want for v in got.values())
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_language_sums_are_dealt_by_their_number_of_words(spark, monkeypatch):
    """The tasks that sum up texts grow in number with the words; texts are dealt once, before they become words."""
    from pyspark.sql import functions as F
    from tonekit.operators import language
    docs = spark.range(60).select("id", F.expr("cast(id % 2 as int)").alias("rank_sentence"), F.expr("if(id = 7, '...', repeat('the house ', 50))").alias("sentence"),
                                  F.lit("en").alias("lang"))
    prof = build_profiles(docs, "sentence").localCheckpoint()
    monkeypatch.setattr(language, "WORDS_PER_TASK", 100)
    out = detect_language(docs, prof)
    assert out.rdd.getNumPartitions() == 60  # 5,900 words and one text without
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.language, r["count"]) for r in out.groupBy("language").count().collect()} == {("en", 59), ("no features in text", 1)}


def test_read_lexicon_file_scores_like_fixture(spark, lexicon):
    import os
    from tonekit.operators.scoring import score_sentences
    from tonekit.sources.lexicon import FIXTURE_LEXICON_TEXT, read_lexicon
    folder = tempfile.mkdtemp(prefix="tonekit-lex-")
    with open(os.path.join(folder, "lexicon.csv"), "w", encoding="utf-8") as fh:
        fh.write("word,valence,polarity,subjectivity\n" + FIXTURE_LEXICON_TEXT)
    from_file = read_lexicon(spark, folder)
    assert from_file.count() == lexicon.count()
    df = spark.createDataFrame([(1, 0, "für was it with as"), (2, 0, "nothing here")], "id long, rank_sentence int, sentence string")
    a = score_sentences(df, from_file).orderBy("id").collect()
    b = score_sentences(df, lexicon).orderBy("id").collect()
    assert a == b


def test_write_corpus_csv_round_trip(spark):
    from tonekit.plans.corpus import build_corpus, write_corpus
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    docs = build_corpus(pages, columns=["page_id", "title", "speech"])
    out = tempfile.mkdtemp(prefix="tonekit-corpus-csv-") + "/docs"
    write_corpus(docs, out, fmt="csv")
    back = read_corpus_csv(spark, out, docs.schema, sep=";", quote="'")
    assert back.count() == docs.count() and back.exceptAll(docs).count() == 0
