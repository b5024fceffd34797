"""Page set -> links and fields (H1, H2, H6), one narrow stage over ``pages``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonekit.functions.html import absolutize, element_text, first_match, link_targets, plain_markup
from tonekit.functions.patterns import DEFAULT_INFO
from tonekit.functions.text import clean_transcript, default_if_blank, let, parse_date, space_after_dot, strip
from tonekit.operators.generate import explode_rows


def site_base(url: Column | str) -> Column:
    """Scheme and host of a URL (``http://host``)."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def extract_links(df: DataFrame, html_col: str, href_regex: str, base: str | Column,
                  keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """H1 + H2: ``(*keys, pos, link)`` for every ``<a href>`` matching ``href_regex``, made absolute."""
    base_col = F.lit(base) if isinstance(base, str) else base
    rows = explode_rows(df, link_targets(html_col), ["pos", "href"], [*keys, base_col.alias("_base")], with_pos=True)
    rows = rows.where(F.col("href").rlike(href_regex))
    return rows.select(*keys, "pos", absolutize(F.col("href"), F.col("_base")).alias("link"))


def append_literals(df: DataFrame, rows: Sequence[tuple], schema) -> DataFrame:
    """Append hand-listed rows (a small literal table) to an extracted set."""
    spark = df.sparkSession
    return df.unionByName(spark.createDataFrame(list(rows), schema))


# Selectors of the stored pages: title, body with a fallback, side information, person and date.
TITLE = ("h1", None)
BODY = (("div", "transcript-inner"), ("article", None))
INFO = ("div", "ad")
NAME = ("p", "president-name")
DATE = ("p", "episode-date")


def extract_pages(df: DataFrame, html_col: str = "html", keys: Sequence[str] = ("page_id", "url"),
                  title=TITLE, body=BODY, info=INFO, name=NAME, date=DATE) -> DataFrame:
    """H6: one row per page: ``title``, ``doc_title``, ``speech`` (H4 fallback, T4 + T3 cleaned),
    ``info`` (H5 default), ``name`` (of the person), ``date`` (T8), ``n_links``. Missing elements are null."""
    cut = df.select(*keys, F.size(link_targets(html_col)).alias("n_links"), plain_markup(html_col).alias("_plain"))

    def text(selector) -> Column:
        return element_text("_plain", *selector, plain=True)

    side = let(text(info), lambda t: F.regexp_replace(t, r"\n", " "))
    return cut.select(
        *keys,
        text(title).alias("title"),
        text(("title", None)).alias("doc_title"),
        space_after_dot(clean_transcript(first_match("_plain", body, plain=True))).alias("speech"),
        let(side, lambda t: default_if_blank(t, DEFAULT_INFO)).alias("info"),
        strip(text(name)).alias("name"),
        parse_date(text(date)).alias("date"),
        "n_links",
    )


__all__ = ["extract_links", "extract_pages", "site_base", "absolutize", "append_literals"]
