"""Token annotations: JSON array of tokens -> MAP<index, STRUCT<word, lemma, pos, ner>>.

A repeated index keeps the last token with that index (as a dict built in order would). This is
done explicitly by sorting the entries by (index, position) and keeping the last of each run, so
the result does not depend on the session's map-key dedup policy; O(n log n) per text.
Lambdas only touch their own arguments: a lambda that reads another array expression makes
Catalyst evaluate that expression once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATION_SCHEMA = "array<struct<index:int,word:string,lemma:string,pos:string,ner:string>>"


def _sorted_entries(json_col: Column) -> Column:
    """Parsed tokens as ``struct(k, o, v)`` sorted by (index, position)."""
    toks = F.filter(F.from_json(json_col, ANNOTATION_SCHEMA), lambda t: t["index"].isNotNull())
    keyed = F.transform(toks, lambda t, i: F.struct(
        t["index"].alias("k"), i.alias("o"),
        F.struct(t["word"].alias("word"), t["lemma"].alias("lemma"),
                 t["pos"].alias("pos"), t["ner"].alias("ner")).alias("v")))
    return F.array_sort(keyed)


def _last_per_key(ordered: Column) -> Column:
    n = F.size(ordered)
    # Key of the next entry (null after the last one), so each entry is compared with its
    # neighbour inside zip_with without the lambda looking into the array itself.
    next_keys = F.concat(F.slice(F.transform(ordered, lambda e: e["k"]), 2, F.greatest(n - 1, F.lit(0))),
                         F.array(F.lit(None).cast("int")))
    last = F.filter(F.zip_with(ordered, next_keys, lambda e, nk: F.when(nk.isNull() | (nk != e["k"]), e)),
                    lambda e: e.isNotNull())
    entries = F.transform(last, lambda e: F.struct(e["k"], e["v"]))
    return F.when(n > 0, F.map_from_entries(entries)).otherwise(F.map_from_entries(F.slice(entries, 1, 0)))


def tokens_to_map(json_col: Column | str) -> Column:
    """N11 as one column expression (fine for small inputs; ``with_token_map`` stages the sort)."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return _last_per_key(_sorted_entries(c))


def with_token_map(df: DataFrame, json_col: str, out: str = "tokens") -> DataFrame:
    """N11 on a DataFrame: the sorted entries are their own column, so the JSON is parsed and
    sorted once per row (inside one expression Catalyst would rebuild it for every reference)."""
    staged = df.withColumn("_ordered", _sorted_entries(F.col(json_col)))
    return staged.withColumn(out, _last_per_key(F.col("_ordered"))).drop("_ordered")


def annotate_words(text: Column | str) -> Column:
    """Annotation JSON from our own word tokenizer: 1-based index, word as written, lower-cased lemma.

    No part-of-speech or entity tagger is involved: ``pos`` and ``ner`` are absent (null).
    """
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    toks = F.transform(words, lambda w, i: F.struct((i + 1).alias("index"), w.alias("word"),
                                                    F.lower(w).alias("lemma")))
    return F.to_json(toks)
