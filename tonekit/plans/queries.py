"""Registered queries: one per operator family of the inventory, each over the given tables.

Every callable takes ``(spark, base_dir)`` and returns a DataFrame over the whole tables.
Doubles that come out of aggregates are rounded to 6 digits (``_r6``), the same way as in the
SQL oracles, so results compare exactly across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tonekit.functions.html import element_text, first_match
from tonekit.functions.numeric import exact_mean, round_half_up
from tonekit.functions.text import (
    clean_post, clean_transcript, default_if_blank, open_end_year, panel_title, parse_date,
    space_after_dot, split_part, strip, try_int, year_of_text,
)
from tonekit.functions.patterns import DEFAULT_INFO
from tonekit.operators import agreement as agr
from tonekit.operators import clean, joins, stats, windows
from tonekit.operators.boundaries import boundary_statistics, explode_learned
from tonekit.operators.generate import explode_rows
from tonekit.operators.html_extract import append_literals, extract_links, extract_pages, site_base
from tonekit.operators.language import build_profiles, detect_language, materialize_profiles
from tonekit.operators.scoring import score_sentences, tokenize
from tonekit.operators.sentences import drop_noise_sentences, explode_sentences, split_sentences
from tonekit.operators.trained import score_trained, train_ordinal
from tonekit.operators.tokens_map import annotate_words, with_token_map
from tonekit.plans.corpus import build_corpus, metadata_from_table
from tonekit.plans.figures import figure_rows
from tonekit.plans.sentiment import conversation_posts, score_posts, sentiment_table
from tonekit.session import materialize, shared_folder
from tonekit.sources.csv import read_corpus_csv, write_corpus_csv
from tonekit.sources.html_table import html_table
from tonekit.sources.lexicon import fixture_lexicon, induced_lexicon
from tonekit.sources.tables import read_pages, read_table
from tonekit.streaming.scoring_stream import start_scoring_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _r6(c):
    return round_half_up(c, 6)


# ---- shared inputs -------------------------------------------------------------------------

def doc_sentences(spark, d) -> DataFrame:
    return explode_sentences(read_table(spark, d, "documents"), "doc_id", "text", 1, keep=["lang", "source"])


def doc_scored(spark, d, negation: bool = False) -> DataFrame:
    return score_sentences(doc_sentences(spark, d), fixture_lexicon(spark), negation=negation)


def conv_scored(spark, d) -> DataFrame:
    posts = conversation_posts(read_table(spark, d, "conversations"))
    return score_sentences(explode_sentences(posts, "post_id", "text", 0, keep=["author"]), fixture_lexicon(spark))


def labeled_scored(spark, d) -> DataFrame:
    """Scored sentences of the documents that have a label: joined before any text is split."""
    labels = read_table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    docs = read_table(spark, d, "documents").join(joins.broadcast_if_small(labels), "doc_id")
    return score_sentences(explode_sentences(docs, "doc_id", "text", 1, keep=["quality"]), fixture_lexicon(spark))


def corpora(spark, d) -> DataFrame:
    cols = ["id", "rank_sentence", "compound", "polarity", "ordinal"]
    return clean.stack([doc_scored(spark, d).select(*cols), conv_scored(spark, d).select(*cols)],
                       ["documents", "conversations"])


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


# ---- flagship --------------------------------------------------------------------------------

@query("lang_summary")
def q_lang_summary(spark, d):
    """Scored sentences per language: count, exact mean and median compound, mean polarity.

    Everything comes from one value-count table (per language and distinct compound score), so
    the corpus is scanned and scored once.
    """
    vc = stats.value_counts(doc_scored(spark, d), "compound", ["lang"], sums=["compound", "polarity"])
    n = F.sum("c").cast("double")
    agg = vc.groupBy("lang").agg(F.sum("c").alias("n_sentences"),
                                 _r6(F.try_divide(F.sum("s_compound").cast("double"), n)).alias("mean_compound"),
                                 _r6(F.try_divide(F.sum("s_polarity").cast("double"), n)).alias("mean_polarity"))
    med = stats.median_from_counts(vc, "lang").select("lang", _r6(F.col("median")).alias("median_compound"))
    return agg.join(med, "lang", "left")


# ---- sources ---------------------------------------------------------------------------------

@query("csv_roundtrip")
def q_csv_roundtrip(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    path = _scratch(spark)
    write_corpus_csv(docs, path, sep=";", quote="'")
    return read_corpus_csv(spark, path, docs.schema, sep=";", quote="'")


@query("page_title")
def q_page_title(spark, d):
    return read_pages(spark, d).select("page_id", element_text("html", "title").alias("title"))


@query("page_links")
def q_page_links(spark, d):
    pages = read_pages(spark, d)
    return extract_links(pages, "html", r"^/", site_base("url"))


SEED_LINKS = ("http://seed.example.com/first", "http://seed.example.com/second")


@query("links_with_seeds")
def q_links_with_seeds(spark, d):
    links = extract_links(read_pages(spark, d), "html", r"^/", site_base("url")).select("page_id", "link")
    schema = StructType([StructField("page_id", LongType()), StructField("link", StringType())])
    return append_literals(links, [(None, s) for s in SEED_LINKS], schema)


@query("page_body")
def q_page_body(spark, d):
    body = first_match("html", [("div", "transcript-inner"), ("article", None)])
    return read_pages(spark, d).select("page_id", body.alias("body"))


@query("page_body_parsed")
def q_page_body_parsed(spark, d):
    """H4 on nested markup: the body sits in an element of its own name, which must end at its own close tag."""
    nested = F.regexp_replace(F.regexp_replace("html", "(?i)<article>", "<article class='outer'><article>"),
                              "(?i)</article>", "</article></article><p>after</p>")
    return read_pages(spark, d).select("page_id", first_match(nested, [("div", "transcript-inner"), ("article", None)]).alias("body"))


@query("page_info_default")
def q_page_info_default(spark, d):
    return read_pages(spark, d).select(
        "page_id",
        default_if_blank(element_text("html", "div", "ad"), DEFAULT_INFO).alias("info_ad"),
        default_if_blank(element_text("html", "div", "about-sidebar--intro"), DEFAULT_INFO).alias("info_sidebar"))


@query("page_extract")
def q_page_extract(spark, d):
    return extract_pages(read_pages(spark, d))


def _escaped(c) -> F.Column:
    out = F.col(c) if isinstance(c, str) else c
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def order_pages(spark, d) -> DataFrame:
    """Stand-in pages: per customer a table of the orders, the customer's cell over all rows, a table in each last cell."""
    orders = read_table(spark, d, "orders").where("o_custkey IS NOT NULL")
    cells = F.concat(F.lit("<td>"), F.col("o_orderkey"), F.lit("<td class=x>"), _escaped("o_orderpriority"),
                     F.lit("</td><td><p>in <table><tr><td>of "), F.col("o_orderstatus"), F.lit("</td></tr></table></p></td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("markup"))))
    pages = orders.groupBy(F.col("o_custkey").alias("page_id")).agg(rows.alias("rows"))
    head = ("<table><tr><td>first</td></tr></table><!-- <table> --><TABLE border='1'><tr><th>Customer</th><th>Order</th>"
            "<th>Priority</th><th>State</th></tr><tr><td rowspan=\"")
    first = F.concat(F.lit(head), F.size("rows"), F.lit('">'), F.lit("Customer &amp; "), F.col("page_id"), F.lit("</td>"))
    markup = F.array_join(F.transform("rows", lambda r: r["markup"]), "<tr>")
    return pages.select("page_id", F.concat(first, markup, F.lit("</table><table></table>")).alias("html"))


@query("html_table_rows")
def q_html_table_rows(spark, d):
    """S4 on the second table of each page: a cell over all rows, tables inside cells, cells without close tags."""
    return html_table(order_pages(spark, d), "html", 1)


@query("html_list_rows")
def q_html_list_rows(spark, d):
    """S4 on lists: every item of the first list is a row."""
    return html_table(read_pages(spark, d), "html", 0, table_tag="ul", row_tag="li", cell_tags=("a",), header=False)


def speech_pages(spark, d) -> DataFrame:
    """Stand-in pages of the corpus build: a document as transcript, date and person of the order with its number."""
    docs = read_table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "source", "text")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, d, "customer").select("c_custkey", "c_name")
    rows = (docs.join(orders, docs["doc_id"] == orders["o_orderkey"], "left")
                .join(joins.broadcast_if_small(cust), F.col("o_custkey") == F.col("c_custkey"), "left"))
    date = F.concat(F.lit('<p class="episode-date">'), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</p>"))
    person = F.concat(F.lit('<div class="about-sidebar--intro"><p class=president-name> '), F.col("c_name"), F.lit("</p></div>"))
    html = F.concat(F.lit("<html><h1>"), _escaped(F.coalesce("source", F.lit(""))), F.lit("</h1>"), F.coalesce(person, F.lit("")),
                    F.coalesce(date, F.lit("")), F.lit('<div class="transcript-inner wide"><div>'),
                    _escaped(F.coalesce("text", F.lit(""))), F.lit("</div></div></html>"))
    return rows.select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), html.alias("html"))


def leader_pages(spark, d) -> DataFrame:
    """Stand-in metadata pages: per nation a table of its customers with segment, a range of years and a deputy."""
    cust = read_table(spark, d, "customer").where("c_custkey IS NOT NULL AND c_nationkey IS NOT NULL")
    start = F.lit(1990) + F.col("c_custkey") % 9
    end = F.when(F.col("c_custkey") % 7 == 0, F.lit("Incumbent")).otherwise(F.concat(F.lit("March 4, "), start + 4))
    deputy = F.when(F.col("c_custkey") % 5 == 0, F.lit("Vacant")).otherwise(F.concat(F.lit("Deputy "), F.col("c_custkey") % 3))
    row = F.concat(F.lit("<tr><td>"), F.col("c_name"), F.lit("[1]</td><td>"), F.col("c_mktsegment"), F.lit("</td><td>March 4, "),
                   start, F.lit(" – "), end, F.lit("</td><td>"), deputy, F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "")
    head = "<table><tr><th>Leader[a]</th><th>Party.1</th><th>Term</th><th>Deputy[b]</th></tr>"
    return cust.groupBy(F.col("c_nationkey").alias("page_id")).agg(F.concat(F.lit(head), rows, F.lit("</table>")).alias("html"))


CORPUS_CUTOFF = "1995-01-01"


@query("corpus_build")
def q_corpus_build(spark, d):
    """The corpus build: page fields, metadata from tables of other pages (S4, P4, T1, T7-T9, J3, T2, U3, F8), enrichment
    (J4), a segment split by date (P5), defaults (P9) and the final projection (P1)."""
    meta = metadata_from_table(leader_pages(spark, d), ["Leader", "Party.1", "Term", "Deputy"], range_col="Term",
                               count_key="Leader", count_col="Deputy", exclude_text="Vacant",
                               name_map={"Customer#0{0,8}": "Customer "}, drop_positions=[16], drop_last=True)
    meta = clean.rename(meta, {"Leader": "name", "Party": "party"})
    pages = speech_pages(spark, d).withColumn("html", F.regexp_replace("html", "> Customer#0{0,8}", "> Customer "))
    party, date, cutoff = F.col("party"), F.col("date"), F.lit(CORPUS_CUTOFF).cast("date")
    old, new = (party == "BUILDING") & (date < cutoff), (party == "BUILDING") & (date > cutoff)
    return build_corpus(pages, materialize(meta), "name", ["page_id", "title", "name", "party", "from", "until", "n_Deputy", "date", "info", "speech"],
                        recodes={"party": [(old, "BUILDING 1"), (new, "BUILDING 2")]}, fills={"n_Deputy": 0},
                        info=("div", "about-sidebar--intro"))


# ---- projections, recodes ------------------------------------------------------------------

@query("meta_projection")
def q_meta_projection(spark, d):
    cust = read_table(spark, d, "customer")
    out = clean.project(cust, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    out = clean.drop(out, ["c_acctbal"])
    return clean.rename(out, {"c_name": "name", "c_mktsegment": "segment"})


@query("clean_column_names")
def q_clean_column_names(spark, d):
    cust = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("Key[a]"), F.col("c_name").alias("Name.1"), F.col("c_mktsegment").alias("Segment[b]"))
    return clean.clean_names(cust)


RECODE_CUTOFF = "1998-01-01 00:00:00"   # compared as TIMESTAMP_NTZ: no session time zone involved


@query("recode_conditional")
def q_recode_conditional(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    cutoff = F.lit(RECODE_CUTOFF).cast("timestamp_ntz")
    out = clean.recode(orders, "o_orderpriority", [
        (urgent & (F.col("o_orderdate") < cutoff), "1-URGENT 1"),
        (urgent & (F.col("o_orderdate") > cutoff), "1-URGENT 2"),
    ])
    return out.select("o_orderkey", "o_orderpriority")


@query("agreement_flags")
def q_agreement_flags(spark, d):
    out = agr.agreement_flags(doc_scored(spark, d))
    return out.select("id", "rank_sentence", "cat_compound", "cat_polarity", "cat_ordinal",
                      "flag_compound_polarity", "flag_compound_ordinal", "flag_polarity_ordinal")


@query("corpus_union")
def q_corpus_union(spark, d):
    return corpora(spark, d)


@query("year_of")
def q_year_of(spark, d):
    orders = read_table(spark, d, "orders")
    return orders.select(
        "o_orderkey", F.year("o_orderdate").alias("year"),
        year_of_text(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("year_text"),
        try_int(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("priority_num"))


@query("fill_missing")
def q_fill_missing(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    return clean.fill(docs.join(labels, "doc_id", "left"), "quality", -1)


@query("speech_progress")
def q_speech_progress(spark, d):
    sents = explode_sentences(read_table(spark, d, "documents"), "doc_id", "text", 1, with_count=True)
    return windows.speech_progress(sents).select("id", "rank_sentence", "cumcount", "percentage")


# ---- filters -------------------------------------------------------------------------------

@query("filter_contains")
def q_filter_contains(spark, d):
    return clean.where_contains(read_table(spark, d, "part"), "p_name", "red").select("p_partkey", "p_name")


@query("filter_regex_any")
def q_filter_regex_any(spark, d):
    return clean.where_rlike(read_table(spark, d, "part"), "p_name", "widget|gear").select("p_partkey", "p_name")


@query("filter_not_contains")
def q_filter_not_contains(spark, d):
    return clean.where_not_contains(read_table(spark, d, "part"), "p_name", "small").select("p_partkey", "p_name")


@query("filter_threshold")
def q_filter_threshold(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return clean.where_gt(orders, "year", 1999)


@query("hist_by_group")
def q_hist_by_group(spark, d):
    scored = labeled_scored(spark, d).where(F.col("quality").isin(0, 1))
    out = stats.histogram_pct(scored, "compound", "quality", 20)
    return out.select("quality", "bin", _r6(F.col("bin_lo")).alias("bin_lo"), _r6(F.col("bin_hi")).alias("bin_hi"),
                      "n", _r6(F.col("pct")).alias("pct"))


@query("filter_equals")
def q_filter_equals(spark, d):
    return clean.where_eq(read_table(spark, d, "documents").select("doc_id", "lang"), "lang", "en")


@query("nonzero_pairs")
def q_nonzero_pairs(spark, d):
    return clean.drop_if_any_zero(doc_scored(spark, d), ["compound", "polarity"]).select(
        "id", "rank_sentence", "compound", "polarity")


@query("sentence_filter")
def q_sentence_filter(spark, d):
    docs = read_table(spark, d, "documents")
    raw = explode_rows(docs, split_sentences("text"), ["pos", "sentence"], [F.col("doc_id").alias("id")], with_pos=True)
    return drop_noise_sentences(raw)


@query("drop_position")
def q_drop_position(spark, d):
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    return clean.drop_by_position(nation, ["n_nationkey"], [16], drop_last=True)


# ---- joins ---------------------------------------------------------------------------------

@query("attach_metadata")
def q_attach_metadata(spark, d):
    docs = read_table(spark, d, "documents")
    sents = explode_sentences(docs, "doc_id", "text", 1)
    out = joins.attach_meta(sents, docs, "doc_id", "text")
    return out.select("id", "rank_sentence", "lang", "source", "n_chars")


@query("distinct_count_join")
def q_distinct_count_join(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    out = joins.distinct_count_join(orders, "o_custkey", "o_orderpriority", "o_orderstatus", "P", "n_priorities")
    return out.select("o_orderkey", "o_custkey", "n_priorities")


@query("enrich_left_join")
def q_enrich_left_join(spark, d):
    cust = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.enrich(cust, nation, "c_nationkey").select("c_custkey", "c_name", "n_name")


@query("group_share")
def q_group_share(spark, d):
    out = stats.group_share(corpora(spark, d), "ordinal", "corpus")
    return out.select("ordinal", "corpus", "n", "groupsize", _r6(F.col("perc")).alias("perc"))


@query("score_compound")
def q_score_compound(spark, d):
    return doc_scored(spark, d).select("id", "rank_sentence", "compound")


# ---- dedup and sets ------------------------------------------------------------------------

@query("distinct_rows")
def q_distinct_rows(spark, d):
    return clean.distinct_rows(read_table(spark, d, "documents").select("lang", "source"))


@query("dedupe_text")
def q_dedupe_text(spark, d):
    posts = conversation_posts(read_table(spark, d, "conversations")).withColumn("text", clean_post("text"))
    return clean.dedupe(posts, ["author", "text"], "post_id")


@query("panel_index")
def q_panel_index(spark, d):
    ev = read_table(spark, d, "events")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    out = windows.panel_index(first, "user_id", ["first_ts", "user_id"], ncol=3)
    title = panel_title(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.year("first_ts"))
    return out.select("user_id", "panel", "panel_row", "panel_col", title.alias("title"))


@query("panel_count")
def q_panel_count(spark, d):
    return clean.n_groups(read_table(spark, d, "events"), "user_id")


# ---- string scalars ------------------------------------------------------------------------

@query("strip_footnotes")
def q_strip_footnotes(spark, d):
    return clean.strip_all_brackets(read_table(spark, d, "documents").select("doc_id", "lang", "text"))


NAME_MAP = {"NATION_": "Nation ", "Nation 0": "Nation zero"}


@query("normalise_names")
def q_normalise_names(spark, d):
    return clean.normalise_names(read_table(spark, d, "nation"), NAME_MAP)


@query("clean_text")
def q_clean_text(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", strip(space_after_dot(clean_transcript("text"))).alias("text"))


@query("clean_post")
def q_clean_post(spark, d):
    posts = conversation_posts(read_table(spark, d, "conversations"))
    return posts.select("post_id", "author", clean_post("text").alias("text"))


def _range_text() -> F.Column:
    start = F.date_format("o_orderdate", "MMMM d, yyyy")
    end = F.when(F.col("o_orderstatus") == "O", F.lit("Incumbent")).otherwise(
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1000), "MMMM d, yyyy"))
    return F.concat(start, F.lit(" – "), end)


@query("parse_range")
def q_parse_range(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", _range_text().alias("range_text"))
    return orders.select("o_orderkey", "range_text",
                         F.year(parse_date(split_part("range_text", "–", 1))).alias("from_year"),
                         open_end_year(split_part("range_text", "–", 2)).alias("until_year"))


@query("parse_date")
def q_parse_date(spark, d):
    orders = read_table(spark, d, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(4))
    text = (F.when(F.pmod(F.col("o_orderkey"), F.lit(50)) == 0, F.lit("junk"))
             .when(k == 0, F.date_format("o_orderdate", "MMMM d, yyyy"))
             .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
             .otherwise(F.date_format("o_orderdate", "yyyy")))
    out = orders.select("o_orderkey", text.alias("date_text"))
    return out.withColumn("parsed", parse_date("date_text"))


@query("parse_date_free")
def q_parse_date_free(spark, d):
    """T8 on dates written in many ways, and on text that is no date."""
    orders = read_table(spark, d, "orders").where("o_orderdate IS NOT NULL")
    day = F.dayofmonth("o_orderdate")
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    forms = [F.date_format("o_orderdate", f) for f in (
        "MMM. d yyyy", "d.M.yyyy", "yyyy/M/d", "EEEE, d MMMM yyyy", "yyyyMMdd", "MMM d, ''yy", "MM/dd/yyyy hh:mm a", "yyyy-MM-dd'T'HH:mm:ss'Z'")]
    forms += [F.concat(F.lit("The "), day, suffix, F.lit(" of "), F.date_format("o_orderdate", "MMMM, yyyy")),
              F.concat(F.date_format("o_orderdate", "MMMM d yyyy"), F.lit(" and more"))]
    text = F.get(F.array(*forms), F.pmod("o_orderkey", F.lit(len(forms))).cast("int"))
    return orders.select("o_orderkey", parse_date(text).alias("parsed"))


@query("crosstab_rounded")
def q_crosstab_rounded(spark, d):
    out = agr.crosstab_rounded(doc_scored(spark, d), "compound", "polarity", 1)
    return out.select("compound_round", "polarity_round", "n", _r6(F.col("share")).alias("share"))


@query("tokenize_words")
def q_tokenize_words(spark, d):
    tokens = tokenize(read_table(spark, d, "documents"), "text", ("doc_id",))
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---- scoring -------------------------------------------------------------------------------

@query("sentence_split")
def q_sentence_split(spark, d):
    return doc_sentences(spark, d).select("id", "rank_sentence", "sentence")


@query("boundary_statistics")
def q_boundary_statistics(spark, d):
    """Abbreviations and sentence starters learned from the documents."""
    return boundary_statistics(read_table(spark, d, "documents")).select("word", "kind", _r6(F.col("score")).alias("score"))


@query("sentence_split_learned")
def q_sentence_split_learned(spark, d):
    """N1-N2 with boundaries learned from the same documents."""
    docs = read_table(spark, d, "documents")
    return explode_learned(docs, "doc_id", "text", materialize(boundary_statistics(docs)))


@query("score_documents")
def q_score_documents(spark, d):
    docs = read_table(spark, d, "documents")
    whole = explode_sentences(docs, "doc_id", "text", 0)
    out = score_sentences(whole, fixture_lexicon(spark))
    return out.select("id", "ordinal", "compound", "neu", "neg", "pos", "polarity", "subjectivity")


@query("score_shares")
def q_score_shares(spark, d):
    return doc_scored(spark, d).select("id", "rank_sentence", "neg", "neu", "pos")


@query("score_negation")
def q_score_negation(spark, d):
    return doc_scored(spark, d, negation=True).select("id", "rank_sentence", "compound")


@query("score_modifiers")
def q_score_modifiers(spark, d):
    """N6 in full: boosters, dampers and negators change the valences after them."""
    out = score_sentences(doc_sentences(spark, d), fixture_lexicon(spark), modifiers=True)
    return out.select("id", "rank_sentence", "compound", "neg", "neu", "pos")


def _induced(spark, d) -> DataFrame:
    return induced_lexicon(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("lexicon_induced")
def q_lexicon_induced(spark, d):
    """A lexicon of thousands of words, learned from labelled documents."""
    return _induced(spark, d).select("word", *[F.col(c).cast("double").alias(c) for c in ("valence", "polarity", "subjectivity")])


@query("score_large_lexicon")
def q_score_large_lexicon(spark, d):
    """J6, N4-N8 with the lexicon learned from labelled documents, stored first as it is a model read twice."""
    out = score_sentences(doc_sentences(spark, d), materialize(_induced(spark, d)), modifiers=True)
    return out.select("id", "rank_sentence", "ordinal", "compound", "neg", "neu", "pos", "polarity", "subjectivity")


@query("score_polarity")
def q_score_polarity(spark, d):
    return doc_scored(spark, d).select("id", "rank_sentence", "polarity", "subjectivity")


@query("score_ordinal")
def q_score_ordinal(spark, d):
    return doc_scored(spark, d).select("id", "rank_sentence", "ordinal")


@query("score_ordinal_trained")
def q_score_ordinal_trained(spark, d):
    """N8, trained variant: the class of every document from a model of the labelled ones; no SQL can fit it."""
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = train_ordinal(docs.join(labels, "doc_id").select("text", F.col("quality").alias("label")))
    if model is None:
        raise ValueError("labels of both kinds are needed")
    out = score_trained(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "ordinal", F.round("probability", 6).alias("probability"))


@query("language_id")
def q_language_id(spark, d):
    docs = read_table(spark, d, "documents")
    return detect_language(doc_sentences(spark, d), materialize_profiles(build_profiles(docs)))


@query("sentiment_table")
def q_sentiment_table(spark, d):
    docs = read_table(spark, d, "documents")
    return sentiment_table(docs, "doc_id", "text", fixture_lexicon(spark), 1, keep=["lang", "source"],
                           profiles=materialize_profiles(build_profiles(docs)))


@query("posts_scored")
def q_posts_scored(spark, d):
    posts = conversation_posts(read_table(spark, d, "conversations"))
    out = score_posts(posts, fixture_lexicon(spark))
    return out.select("id", "author", "sentence", "compound", "polarity", "ordinal")


@query("tokens_to_map")
def q_tokens_to_map(spark, d):
    posts = conversation_posts(read_table(spark, d, "conversations"))
    annotated = posts.select("post_id", annotate_words("text").alias("annotation"))
    mapped = with_token_map(annotated, "annotation").select("post_id", "tokens")
    out = explode_rows(mapped, F.col("tokens"), ["index", "attrs"], ["post_id"])
    return out.select("post_id", "index", "attrs.word", "attrs.lemma")


# ---- classes and agreement -------------------------------------------------------------------

@query("polarity_class")
def q_polarity_class(spark, d):
    return agr.classify(doc_scored(spark, d)).select("id", "rank_sentence", "cat_compound", "cat_polarity", "cat_ordinal")


@query("disagreement_types")
def q_disagreement_types(spark, d):
    out = agr.disagreement_types(doc_scored(spark, d))
    return out.select("disagreement", _r6(F.col("one_neutral")).alias("one_neutral"), _r6(F.col("other")).alias("other"))


@query("agreement_pct")
def q_agreement_pct(spark, d):
    return agr.agreement_pct(doc_scored(spark, d)).select("pair", "flag", "n", _r6(F.col("pct")).alias("pct"))


@query("crosstab_classes")
def q_crosstab_classes(spark, d):
    cells = agr.class_cells(doc_scored(spark, d))
    parts = []
    for col in ("cat_compound", "cat_polarity"):
        t = agr.crosstab_classes(cells, "cat_ordinal", col, weight="n")
        parts.append(t.select(F.lit(col).alias("col_class"), "cat_ordinal",
                              *[_r6(F.col(c)).alias(c) for c in ("negative", "neutral", "positive")],
                              "pct_negative", "pct_neutral", "pct_positive"))
    return clean.union_all(parts)


@query("corr_info")
def q_corr_info(spark, d):
    parts = [agr.corr_info(df).withColumn("corpus", F.lit(name))
             for name, df in (("documents", doc_scored(spark, d)), ("conversations", conv_scored(spark, d)))]
    out = clean.union_all(parts)
    return out.select("corpus", _r6(F.col("r")).alias("r"), _r6(F.col("share_one_neutral")).alias("share_one_neutral"))


@query("corr_matrix")
def q_corr_matrix(spark, d):
    out = agr.corr_matrix(doc_scored(spark, d), ["compound", "polarity"])
    return out.select("var1", "var2", _r6(F.col("r")).alias("r"))


# ---- statistics ----------------------------------------------------------------------------

@query("evolution_band")
def q_evolution_band(spark, d):
    out = stats.summary_by(doc_scored(spark, d), "id", "ordinal", "lang", "rank_sentence")
    return out.select("id", "lang", *[_r6(F.col(c)).alias(c) for c in ("mean", "std", "lower", "upper")])


@query("mean_over_time")
def q_mean_over_time(spark, d):
    out = stats.mean_over_time(read_table(spark, d, "events"), "user_id", "value", "event_type", "ts", "ts")
    return out.select("user_id", _r6(F.col("mean")).alias("mean"), "event_type", "year")


@query("scorer_means")
def q_scorer_means(spark, d):
    scored = doc_scored(spark, d)
    out = scored.groupBy("id").agg(exact_mean("compound").alias("mean_compound"),
                                   exact_mean("polarity").alias("mean_polarity"), F.avg("ordinal").alias("mean_ordinal"))
    return out.select("id", *[_r6(F.col(c)).alias(c) for c in ("mean_compound", "mean_polarity", "mean_ordinal")])


@query("ordinal_share")
def q_ordinal_share(spark, d):
    out = stats.value_share(labeled_scored(spark, d), "ordinal", ["quality"])
    return out.select("quality", "ordinal", "n", _r6(F.col("pct")).alias("pct"))


@query("kde_by_corpus")
def q_kde_by_corpus(spark, d):
    out = stats.kde(corpora(spark, d), "compound", "corpus", 100, 3.0)
    return out.select("corpus", "i", _r6(F.col("x")).alias("x"), _r6(F.col("density")).alias("density"))


@query("median_by_group")
def q_median_by_group(spark, d):
    out = stats.median_by(labeled_scored(spark, d), "quality", "compound")
    return out.select("quality", _r6(F.col("median")).alias("median"), "n")


@query("median_raw")
def q_median_raw(spark, d):
    """A17 on raw doubles: the exact median value of each type of event."""
    return stats.median_of_raw(read_table(spark, d, "events"), "event_type", "value")


@query("mann_whitney_exact")
def q_mann_whitney_exact(spark, d):
    """A18 on small groups: mean balances of the nations of two regions, p values by counting orders."""
    cust = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"))
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = nation.join(cust, F.col("n_nationkey") == F.col("c_nationkey"))
    out = stats.mann_whitney(rows, "balance", "n_regionkey", 0, 1)
    return out.select("n1", "n2", "u1", "u2", "method", *[_r6(F.col(c)).alias(c) for c in ("p_two_sided", "p_greater", "p_less")])


@query("mann_whitney")
def q_mann_whitney(spark, d):
    out = stats.mann_whitney(labeled_scored(spark, d), "compound", "quality", 1, 0)
    return out.select("n1", "n2", *[_r6(F.col(c)).alias(c) for c in ("r1", "u1", "u2", "u")], "ties",
                      *[_r6(F.col(c)).alias(c) for c in ("z", "p_two_sided", "p_greater", "p_less")])


@query("series_by_id")
def q_series_by_id(spark, d):
    sents = explode_sentences(read_table(spark, d, "documents"), "doc_id", "text", 1, with_count=True)
    scored = score_sentences(sents, fixture_lexicon(spark))
    prog = windows.speech_progress(scored).select("id", "rank_sentence", "percentage", "polarity")
    rolled = windows.rolling_mean(prog, "polarity", out="ma5")
    out = stats.series_by(rolled, "id", "percentage", "polarity", "ma5")
    return out.select("id", _r6(F.col("x")).alias("x"), _r6(F.col("y")).alias("y"), _r6(F.col("ma")).alias("ma"))


@query("rolling_mean5")
def q_rolling_mean5(spark, d):
    scored = doc_scored(spark, d).select("id", "rank_sentence", "polarity")
    out = windows.rolling_mean(scored, "polarity", out="polarity_ma5")
    return out.select("id", "rank_sentence", _r6(F.col("polarity")).alias("polarity"),
                      _r6(F.col("polarity_ma5")).alias("polarity_ma5"))


@query("top_n_per_group")
def q_top_n_per_group(spark, d):
    posts = conversation_posts(read_table(spark, d, "conversations")).select("post_id", "author")
    return windows.top_n_per_group(posts, "author", "post_id", 100)


@query("sort_sentences")
def q_sort_sentences(spark, d):
    """O1: all sentences by label, unlabelled ones last."""
    labels = read_table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    sents = doc_sentences(spark, d).select("id", "rank_sentence").join(joins.broadcast_if_small(labels), "id", "left")
    order = [F.col("quality").asc_nulls_last(), "id", "rank_sentence"]
    return windows.sort_by(sents, order).select("quality", "id", "rank_sentence")


@query("evolution_by_date")
def q_evolution_by_date(spark, d):
    """A3 in full: mean, spread, first language and earliest date per document, dates taken from orders."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"))
    scored = doc_scored(spark, d).select("id", "rank_sentence", "ordinal", "lang").join(orders, "id", "left")
    out = stats.summary_by(scored, "id", "ordinal", "lang", "rank_sentence", "date")
    return out.select("id", "lang", "date", *[_r6(F.col(c)).alias(c) for c in ("mean", "std", "lower", "upper")])


@query("comparative_figures")
def q_comparative_figures(spark, d):
    """Every table of the agreement figures as rows."""
    out = figure_rows(doc_scored(spark, d))
    return out.select("figure", "row", "col", "n", _r6(F.col("share")).alias("share"))


# ---- streaming -------------------------------------------------------------------------------

@query("stream_scores")
def q_stream_scores(spark, d):
    """The scoring job run as a file stream (available-now trigger) over the documents file."""
    docs = read_table(spark, d, "documents")
    base = _scratch(spark)
    q = start_scoring_stream(spark, f"{d.rstrip('/')}/documents*.parquet", docs.schema, fixture_lexicon(spark),
                             f"{base}/out", f"{base}/checkpoint", "doc_id", "text", 1, keep=["lang"])
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("id", "rank_sentence", "lang", "compound", "polarity", "ordinal")
