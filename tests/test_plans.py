"""Composite plans: corpus build, metadata table, analysis run."""
import tempfile

from pyspark.sql import functions as F

from tonekit.plans.corpus import build_corpus, metadata_from_table, write_corpus
from tonekit.plans.figures import analysis

SF = "/root/testdata/sf0.001"

TABLE_PAGE = (
    "<html><body><table><tr><th>Term[a]</th><th>Leader</th><th>Deputy</th></tr>"
    "<tr><td>March 4, 1885 – March 4, 1889</td><td>Ann Example</td><td>Bo Sample</td></tr>"
    "<tr><td>March 4, 1893 – March 4, 1897</td><td>Ann Example</td><td>Cy Sample</td></tr>"
    "<tr><td>January 20, 2017 – Incumbent</td><td>A &amp; B[1]</td><td>Vacant</td></tr>"
    "</table></body></html>")


def test_build_corpus_one_row_per_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = build_corpus(pages, columns=["page_id", "title", "speech", "info"])
    rows = docs.collect()
    assert len(rows) == pages.count()
    assert all(r.speech and r.title for r in rows)
    out = tempfile.mkdtemp(prefix="tonekit-corpus-") + "/docs"
    write_corpus(docs, out)
    assert spark.read.parquet(out).count() == len(rows)


def test_metadata_from_table(spark):
    pages = spark.createDataFrame([(1, TABLE_PAGE)], "page_id long, html string")
    meta = metadata_from_table(pages, ["Term", "Leader", "Deputy"], range_col="Term",
                               count_key="Leader", count_col="Deputy", exclude_text="Vacant",
                               name_map={"A & B": "A and B"})
    rows = {(r.Leader, r["from"]): r for r in meta.collect()}
    assert rows[("Ann Example", 1885)]["until"] == 1889
    assert rows[("Ann Example", 1893)]["n_Deputy"] == 2
    assert rows[("A and B", 2017)]["until"] == 2021
    assert rows[("A and B", 2017)]["n_Deputy"] is None


def test_metadata_table_is_parsed_once(spark):
    pages = spark.createDataFrame([(1, TABLE_PAGE)], "page_id long, html string")
    meta = metadata_from_table(pages, ["Term", "Leader", "Deputy"], range_col="Term", count_key="Leader", count_col="Deputy",
                               exclude_text="Vacant", drop_positions=[0], drop_last=True)
    assert "MapInArrow" not in meta._jdf.queryExecution().toString()  # neither the count nor the positions parse pages again


def test_analysis_run(spark, lexicon):
    res = analysis(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/conversations.parquet"),
                   spark.read.parquet(f"{SF}/labels.parquet"), lexicon)
    assert {"hist_compound", "kde_compound", "median", "mann_whitney", "documents_agreement_pct",
            "conversations_values"} <= set(res)
    mw = res["mann_whitney"].first()
    assert mw.u1 + mw.u2 == mw.n1 * mw.n2
    for pair_rows in [res["documents_agreement_pct"].collect()]:
        for pair in {r.pair for r in pair_rows}:
            assert abs(sum(r.pct for r in pair_rows if r.pair == pair) - 100) < 1e-9
    hist = res["hist_compound"].groupBy("quality").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in hist)


def test_comparative_panels(spark, lexicon):
    from tonekit.operators.scoring import score_sentences
    from tonekit.operators.sentences import explode_sentences
    from tonekit.plans.figures import comparative_panels
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = score_sentences(explode_sentences(docs, "doc_id", "text", 1, with_count=True), lexicon)
    meta = docs.select(F.col("doc_id").alias("id"), "lang", F.lit(2001).alias("year"))
    out = comparative_panels(scored, meta, ["lang", "id"], "lang", "year")
    panels = out["panels"].collect()
    assert sorted(r.panel for r in panels) == list(range(docs.count()))
    assert all(r.title.endswith(" - 2001") and r.panel_col == r.panel % 3 for r in panels)
    series = out["series"]
    assert series.count() == scored.count()
    assert series.where(F.col("ma").isNotNull()).count() > 0
    assert out["means"].count() == scored.select("id").distinct().count()
