"""Operator 13: license scan, an exact set-similarity join of text blocks with license templates.

Blocks. A template of w words belongs to class L, the least power of two that is at least w and 8; for each
class a text is cut into blocks of 2L words that start at every L-th word, so every passage of up to L words lies in one block.

Join. A block matches a template when it holds at least ``ceil(THRESHOLD * size)`` of the template's distinct words. All
template words are counted over all texts, and both sides order their words by that count, rarest first (words of no
template can't add to an overlap and are left out of blocks). With ``need`` the overlap asked for:

* prefix filter: a match shares a word among the template's first ``size - need + 1`` and the block's first
  ``size - need + 1`` words, so these are what the join is on;
* length filter: a block has at least ``need`` words;
* positional filter: a shared word at places p and q allows an overlap of at most
  ``min(p, q) + 1 + min(words left on either side)``;
* what is left is verified on the full sets.

The driver holds the templates and one count per template word. Blocks leave a task only if a word of some template's
prefix is in them; matches are counted per row, so a line that a third of all texts share costs one row a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

#: Share of a template's distinct words that a block must hold; shortest class of blocks.
THRESHOLD, SHORTEST = 0.9, 8
#: Rows of the templates' prefix index up to which it is broadcast.
FEW_ROWS = 100_000
#: Bytes of text in one vectorised pass.
BATCH = 1 << 22

# Phrases of the base scan, and customary notices of well-known licenses as templates.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
)

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256, dtype=np.uint8)  # upper case to lower, bytes between words to blanks
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BYTES[65:91] += 32


class Template(NamedTuple):
    """A template: its label, class and distinct words, and how many of them a block must hold."""

    label: str
    span: int
    words: tuple[str, ...]
    need: int


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def compiled(templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        words = words_of(text)
        own = tuple(dict.fromkeys(words))
        span = max(SHORTEST, 1 << (len(words) - 1).bit_length())
        out.append(Template(label, span, own, max(1, -int(-threshold * len(own) // 1))))
    return out


class _Words(NamedTuple):
    """Words of a batch: vocabulary number (-1: none) and row of each, first word and number of words of each row."""

    codes: np.ndarray
    row: np.ndarray
    begins: np.ndarray
    counts: np.ndarray


def _passes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``BATCH`` bytes of column ``at``, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < len(ends):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BATCH, side="right")))
            yield batch.slice(first, stop - first)
            first = stop


def _read(texts: pa.Array, vocabulary: pa.Array) -> _Words:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_BYTES[data].tobytes()))
    parts = pc.ascii_split_whitespace(clean)
    flat = parts.flatten()
    row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    flat, row = flat.filter(pa.array(filled)), row[filled]
    counts = np.bincount(row, minlength=len(texts))
    if not len(flat):
        return _Words(np.zeros(0, np.int64), row, np.cumsum(counts) - counts, counts)
    coded = flat.dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, vocabulary.cast(pa.large_string())), -1).to_numpy(zero_copy_only=False)
    return _Words(number[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64), row, np.cumsum(counts) - counts, counts)


def word_counts(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each of ``vocabulary`` occurs in all texts: one row per word and task, summed by Spark."""
    known = list(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for batch in _passes(batches, 0):
            total += np.bincount(_read(batch.column(0), pa.array(known)).codes + 1, minlength=len(known) + 1)
        yield pa.RecordBatch.from_pydict({"word": pa.array(known, pa.string()), "n": total[1:]})

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(known, 0) | {r["word"]: r["n"] for r in rows}


def _base(w: _Words, phrases: list[tuple[list[int], str]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Number of base places, labels, first and last start (-1: none) per row."""
    rows = len(w.counts)
    starts, found = [], [set() for _ in range(rows)]
    for codes, label in phrases:
        last = len(w.codes) - len(codes) + 1
        hit = np.ones(max(last, 0), bool)
        for k, code in enumerate(codes):
            hit &= (w.codes[k:k + len(hit)] == code) & (w.row[k:k + len(hit)] == w.row[:len(hit)])
        at = np.flatnonzero(hit)
        starts.append(at)
        for r in np.unique(w.row[at]):
            found[r].add(label)
    at = np.sort(np.concatenate(starts))
    of, place = w.row[at], at - w.begins[w.row[at]]
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    np.minimum.at(first, of, place)
    np.maximum.at(last, of, place)
    return np.bincount(of, minlength=rows), [",".join(sorted(f)) for f in found], np.where(last < 0, -1, first), last


def _blocks(w: _Words, rare: dict[int, np.ndarray]) -> list[list[dict]]:
    """Per row the blocks that hold a word of a prefix: class, start and the vocabulary words, rarest first."""
    out: list[list[dict]] = [[] for _ in w.counts]
    at = np.flatnonzero(w.codes >= 0)
    codes, row = w.codes[at], w.row[at]
    place = at - w.begins[row]
    for span, is_rare in rare.items():
        width = int(w.counts.max(initial=0)) // span + 2
        key = row * width + place // span + 1  # block before the word's own: key - 1, none at the start of a text
        hit = is_rare[codes]
        own = np.unique(np.concatenate([key[hit], key[hit & (place >= span)] - 1]))
        if not len(own):
            continue
        pairs = []
        for block in (key, np.where(place >= span, key - 1, -1)):
            slot = np.minimum(np.searchsorted(own, block), len(own) - 1)
            inside = own[slot] == block
            pairs.append(slot[inside] * len(is_rare) + codes[inside])
        pairs = np.unique(np.concatenate(pairs))
        slot, words = pairs // len(is_rare), pairs % len(is_rare)
        for k, tokens in enumerate(np.split(words, np.flatnonzero(np.diff(slot)) + 1)):
            r, block = divmod(int(own[k]), width)
            out[r].append({"span": span, "start": (block - 1) * span, "words": tokens.tolist()})
    return out


_BLOCK = pa.list_(pa.struct([("span", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))]))


def scanned(docs: DataFrame, id_col: str, text_col: str, order: Sequence[str], templates: Sequence[Template],
            phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, blocks`` of every row; words by place in ``order``."""
    vocabulary = list(order)
    place = {word: k for k, word in enumerate(vocabulary)}
    spelled = [([place[x] for x in words_of(phrase)], label) for phrase, label in phrases]
    rare: dict[int, np.ndarray] = {}
    for t in templates:
        own = rare.setdefault(t.span, np.zeros(len(vocabulary), bool))
        own[sorted(place[x] for x in t.words)[:len(t.words) - t.need + 1]] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _passes(batches, 1):
            w = _read(batch.column(1), pa.array(vocabulary))
            n_base, labels, first, last = _base(w, spelled)
            none = pa.array(last < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array(n_base.astype(np.int64)),
                 pc.if_else(none, None, pa.array(first)), pc.if_else(none, None, pa.array(last)), pa.array(labels, pa.string()),
                 pa.array(_blocks(w, rare), _BLOCK)],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scan, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "blocks array<struct<span: int, start: long, words: array<int>>>")


def matches(blocks: DataFrame, templates: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``row_no, start, label, containment`` of all blocks (``row_no, span, start, words``) that match a template.

    A pair comes once for each shared word of both prefixes that passes the positional filter.
    """
    place = {word: k for k, word in enumerate(order)}
    index = []
    for t in templates:
        own = sorted(place[x] for x in t.words)
        index += [(t.label, t.span, own, t.need, p, own[p]) for p in range(len(own) - t.need + 1)]
    spark = blocks.sparkSession
    index_df = spark.createDataFrame(index, "label string, span int, own array<int>, need int, p int, word int")
    prefix = blocks.select("*", F.posexplode("words").alias("q", "word"))
    paired = prefix.join(F.broadcast(index_df) if len(index) <= FEW_ROWS else index_df, ["span", "word"])
    size, own = F.size("words"), F.size("own")
    most = F.least("p", "q") + 1 + F.least(own - F.col("p") - 1, size - F.col("q") - 1)
    paired = paired.where((size >= F.col("need")) & (F.col("q") <= size - F.col("need")) & (most >= F.col("need")))
    shared = F.size(F.array_intersect("words", "own"))
    return paired.where(shared >= F.col("need")).select("row_no", "start", "label", (shared / own).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
                 templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's base places and labels, the labels of all templates that a block of it contains, and a score.

    The score is 1 with a base place, else the best containment among matches, else 0. Null and empty texts have no words
    and no labels (empty strings); repeated rows, ties and null ids come back row by row; other columns play no part.
    """
    known = compiled(templates, threshold)
    vocabulary = sorted({x for t in known for x in t.words} | {x for phrase, _ in phrases for x in words_of(phrase)})
    counts = word_counts(docs, text_col, vocabulary)
    order = sorted(vocabulary, key=lambda x: (counts[x], x))
    rows = scanned(docs, id_col, text_col, order, known, phrases)
    rows = staged(rows.withColumn("row_no", F.monotonically_increasing_id()), "scanned")
    found = matches(rows.select("row_no", F.inline("blocks")), known, order)
    found = found.groupBy("row_no").agg(F.collect_set("label").alias("own_labels"), F.max("containment").alias("best"))
    rows = rows.drop("blocks").join(found, "row_no", "left")
    base = F.when(F.col("base_labels") != "", F.split("base_labels", ",")).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, F.coalesce("own_labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels",
                       F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same result from all blocks against all templates of their class."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = ", ".join(f"('{t.label}', {t.span}, {list(t.words)}, {t.need})" for t in compiled(TEMPLATES, THRESHOLD))
    places = []
    for phrase, label in PHRASES:
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words_of(phrase)))
        places.append(f"SELECT r, '{label}' AS label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM words) WHERE {test}")
    return f"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORDS}') AS w FROM documents),
    places AS ({' UNION ALL '.join(places)}),
    base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY r),
    templates(label, span, own, need) AS (VALUES {own}),
    spans AS (SELECT DISTINCT span FROM templates),
    starts AS (SELECT r, w, span, unnest(range(0, len(w), span)) AS s FROM words, spans),
    blocks AS (SELECT r, span, list_distinct(w[s + 1:s + 2 * span]) AS block FROM starts),
    found AS (SELECT r, label, len(list_intersect(block, own)) AS shared, len(own) AS size, need FROM blocks JOIN templates USING (span)),
    own AS (SELECT r, label, shared / size AS containment FROM found WHERE shared >= need),
    every AS (SELECT r, label FROM own UNION SELECT r, label FROM places),
    all_labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY r),
    base_labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
    best AS (SELECT r, max(containment) AS best FROM own GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
    FROM words LEFT JOIN base USING (r) LEFT JOIN all_labels USING (r) LEFT JOIN base_labels USING (r) LEFT JOIN best USING (r)"""


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES: dict[str, str] = {"op13_license_scan": _oracle()}
