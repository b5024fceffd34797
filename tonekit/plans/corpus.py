"""Corpus build: stored pages -> one cleaned row per document, enriched with a metadata table.

The whole build is one lazy plan: page fields are column expressions over the page markup (one
narrow stage), the metadata table is small and joined with a guarded broadcast, and the result
is written once (Parquet for our own stages, the delimited dialect for exchange).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonekit.functions.text import open_end_year, parse_date, split_part, strip_brackets
from tonekit.operators import clean
from tonekit.operators.html_extract import extract_pages
from tonekit.operators.joins import distinct_count_join, enrich
from tonekit.session import stored
from tonekit.sources.csv import write_corpus_csv
from tonekit.sources.html_table import html_table, table_to_columns


def build_corpus(pages: DataFrame, meta: DataFrame | None = None, on: str | Sequence[str] | None = None,
                 columns: Sequence[str] | None = None, recodes: Mapping[str, Sequence] | None = None,
                 fills: Mapping[str, object] | None = None, **selectors) -> DataFrame:
    """H6 + T3/T4 + J4 + P5 + P9 + P1: page fields and cleaned text, metadata joined, columns recoded on conditions
    (``recodes``: column -> [(condition, value)]) and filled (``fills``: column -> value), final projection.

    ``selectors`` go to ``extract_pages``.
    """
    docs = extract_pages(pages, **selectors)
    if meta is not None and on is not None:
        docs = enrich(docs, meta, on)
    for col, cases in (recodes or {}).items():
        docs = clean.recode(docs, col, cases)
    for col, value in (fills or {}).items():
        docs = clean.fill(docs, col, value)
    return docs.select(*columns) if columns else docs


def metadata_from_table(pages: DataFrame, headers: Sequence[str], nth: int = 0,
                        range_col: str | None = None, count_key: str | None = None,
                        count_col: str | None = None, exclude_text: str | None = None,
                        name_map: dict[str, str] | None = None,
                        drop_positions: Sequence[int] = (), drop_last: bool = False) -> DataFrame:
    """The metadata side of the build, from the n-th HTML table of each page.

    S4 + P4: cells to named columns, bracket marks removed from values and names (T1);
    T7 + T8 + T9: an optional ``a – b`` range column becomes ``from`` and ``until`` years;
    J3 + A2 + F3: an optional distinct count per key, joined back;
    T2: optional name normalisation; U3: duplicates removed;
    F8: rows left out by position, in the order of the named columns.

    The named columns are stored where two branches read them (J3, F8): tables are parsed and rows compared once.
    """
    long = html_table(pages, "html", nth, keys=("page_id",))
    long = long.withColumn("header", strip_brackets("header")).withColumn("value", strip_brackets("value"))
    wide = table_to_columns(long, ["page_id"], list(headers))
    wide = clean.clean_names(_once(wide) if count_key and count_col else wide)
    if range_col:
        wide = (wide.withColumn("from", F.year(parse_date(split_part(range_col, "–", 1))))
                    .withColumn("until", open_end_year(split_part(range_col, "–", 2))))
    if count_key and count_col:
        wide = distinct_count_join(wide, count_key, count_col, count_col, exclude_text or "\u0000",
                                   f"n_{count_col}".replace(" ", "_"))
    if name_map:
        wide = clean.normalise_names(wide, name_map)
    wide = clean.distinct_rows(wide.drop("page_id", "row"))
    if drop_positions or drop_last:
        wide = _once(wide)
        wide = clean.drop_by_position(wide, wide.columns, list(drop_positions), drop_last)
    return wide


def _once(df: DataFrame) -> DataFrame:
    """``df`` stored, whatever the names of its columns."""
    return stored(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the built corpus: Parquet, or the ``;`` / ``'`` delimited dialect."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        write_corpus_csv(df, path, sep=";", quote="'")


__all__ = ["build_corpus", "metadata_from_table", "write_corpus"]
