"""Language identification by character-trigram profiles.

Profiles are learned from a labelled corpus: count of each trigram per language, add-one
smoothing over the trigram vocabulary V. A text's score for language L is

    sum over its trigrams of log(count_L(tri) + 1)  -  n_trigrams * log(total_L + V)

Trigrams are taken per word: lower-cased letter runs padded with one blank on each side.

(the second term is the shared denominator of every smoothed probability), so only trigrams
seen in L need a lookup. The winner is the highest score (ties: the larger language code).
Texts without any letter get the fixed fallback label.

Physical plan: a profile has few trigrams, however many texts and different words there are. Its table of weights goes to every
task (``trigram_sums``, if its bytes are proven few) and a text's sums are taken where the text is read: neither texts nor words
are shuffled. ``with_language`` adds the label in that stage. ``detect_language`` sums up rows of one key first: one short row per
text is dealt by its keys to as many tasks as the number of words asks for.

With a profile too large for that, every distinct word of the texts gets its vector once (number of trigrams, and per language the
sum of its weights); texts are dealt by their keys, exploded to words, joined with that table (broadcast if its bytes are proven
few, else a shuffle join that AQE splits on hot words) and summed up per text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonekit.functions.patterns import NO_LANGUAGE, RX_LETTERS, RX_WORD
from tonekit.functions.text import word_tokens
from tonekit.operators.generate import explode_rows
from tonekit.operators.joins import BROADCAST_MAX_BYTES, broadcast_if_small

#: Words of the texts that one task sums up.
WORDS_PER_TASK = 1_000_000
#: Bytes of keys and weights of the profile's trigrams up to which every task gets them all.
TABLE_MAX_BYTES = BROADCAST_MAX_BYTES


def word_trigrams(word: Column) -> Column:
    """3-char windows of `` word `` (the word padded with one blank on each side)."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, 3))


def char_trigrams(text: Column | str) -> Column:
    """Trigrams of every word of a text (words as in ``word_tokens``), each word padded with a blank.

    One linear regex pass per text: runs of non-letters become two blanks, the text is padded with
    one blank, and a look-ahead match takes every 3-char window made of letters with at most a
    blank at one end (or `` x `` for a one-letter word). Windows holding two blanks, the ones that
    cross a word boundary, never match, which leaves exactly the padded per-word trigrams.
    """
    c = F.col(text) if isinstance(text, str) else text
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}]+", "  "), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit("(?=([^ ]{3}| [^ ]{2}|[^ ]{2} | [^ ] ))"), F.lit(1))


def build_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, tri, n)``: trigram counts per language.

    Words are counted first (a large reduction: words repeat far more than texts), then each
    distinct word is expanded to its trigrams weighted by its count. Both steps aggregate map-side.
    """
    words = (docs.where(F.col(lang_col).isNotNull())
                 .transform(lambda d: explode_rows(d, word_tokens(text_col), ["word"], [F.col(lang_col).alias("lang")]))
                 .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")))
    tri = explode_rows(words, word_trigrams(F.col("word")), ["tri"], ["lang", "c"])
    return tri.groupBy("lang", "tri").agg(F.sum("c").alias("n"))


def materialize_profiles(profiles: DataFrame) -> DataFrame:
    """Store the learned profile once (checkpoint folder) so later jobs read it, not the corpus."""
    from tonekit.session import materialize
    return materialize(profiles)


class LanguageModel(NamedTuple):
    """What is read off a profile once: ``consts`` has (lang, log(total_L + V)) per language, ``sums`` is a function that takes a
    text to its number of trigrams and the sums of their weights, or None if the profile is too large to go to every task."""

    profiles: DataFrame
    consts: list[tuple[str, float]]
    sums: Callable[[Column], Column] | None


def language_model(profiles: DataFrame) -> LanguageModel:
    """``profiles`` is a learned model read by several jobs: pass a stored or materialized table (``materialize_profiles``)."""
    vocab = profiles.select("tri").distinct().count()
    rows = profiles.groupBy("lang").agg(F.sum("n").alias("total")).collect()
    consts = sorted((r["lang"], math.log(r["total"] + vocab)) for r in rows)
    if not consts or vocab * (1 + len(consts)) * 8 > TABLE_MAX_BYTES:
        return LanguageModel(profiles, consts, None)
    from tonekit.operators.trigram_sums import sums_udf, trigram_table
    stored = _wide_weights(profiles, [lang for lang, _ in consts]).toArrow()
    weights = np.column_stack([stored[f"_w{i}"].fill_null(0.0).to_numpy() for i in range(len(consts))])
    table = profiles.sparkSession.sparkContext.broadcast(trigram_table(stored["tri"].to_pylist(), weights))
    udf = sums_udf(table, len(consts))
    return LanguageModel(profiles, consts, lambda text: udf(spaced_words(text)))


def spaced_words(text: Column) -> Column:
    """The words of a text (as in ``word_tokens``) with one blank between them and around them; blanks alone for none or a null."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), RX_WORD, " ")
    return F.concat(F.lit(" "), letters, F.lit(" "))


def _wide_weights(profiles: DataFrame, langs: Sequence[str]) -> DataFrame:
    """``tri, _w0, _w1, ...``: one row per trigram with one weight column per language, so a join with it does not multiply rows."""
    return (profiles.groupBy("tri").pivot("lang", list(langs))
                    .agg(F.first(F.log(F.col("n") + F.lit(1.0))))
                    .toDF("tri", *[f"_w{i}" for i in range(len(langs))]))


def word_vectors(words: DataFrame, profiles: DataFrame, langs: Sequence[str]) -> DataFrame:
    """``word, n_tri, _s0, _s1, ...``: per distinct ``word`` its trigrams and the sum of their weights per language."""
    wide = _wide_weights(profiles, langs)
    tri = explode_rows(words, word_trigrams(F.col("word")), ["tri"], ["word"])
    sums = [F.sum(F.coalesce(F.col(f"_w{i}"), F.lit(0.0))).alias(f"_s{i}") for i in range(len(langs))]
    return tri.join(wide, "tri", "left").groupBy("word").agg(F.count(F.lit(1)).alias("n_tri"), *sums)


def _label(consts: Sequence[tuple[str, float]], n: Column, sums: Sequence[Column]) -> Column:
    """The language with the highest score (ties: the larger code) of a text with ``n`` trigrams and these sums of weights."""
    scores = [F.struct((s - n * F.lit(c)).alias("score"), F.lit(lang).alias("lang")) for s, (lang, c) in zip(sums, consts)]
    best = F.array_max(F.array(*scores))["lang"] if scores else F.lit(None).cast("string")
    return F.when(n > 0, best).otherwise(F.lit(NO_LANGUAGE))


def with_language(df: DataFrame, model: LanguageModel, text_col: str = "sentence", out: str = "language") -> DataFrame:
    """``df`` with the language of each row's own text, in the stage that reads it (``model`` must have ``sums``)."""
    cols = df.columns
    summed = df.withColumn("_sums", model.sums(F.col(text_col)))
    return summed.select(*cols, _label(model.consts, F.col("_sums.n"), [F.col(f"_sums.s{i}") for i in range(len(model.consts))]).alias(out))


def detect_language(df: DataFrame, profiles: DataFrame | LanguageModel, keys: Sequence[str] = ("id", "rank_sentence"),
                    text_col: str = "sentence", out: str = "language") -> DataFrame:
    """``(*keys, language)``: a row for each value of ``keys`` in ``df``; rows that share one count as one text.

    ``profiles`` is a learned model read by several jobs (vocabulary size, per-language totals, weights): pass a stored or
    materialized table (``materialize_profiles``), not a lazy aggregate, or its ``language_model``.
    """
    model = profiles if isinstance(profiles, LanguageModel) else language_model(profiles)
    sums = [f"_s{i}" for i in range(len(model.consts))]
    if model.sums is None:
        per_row = _word_sums(df, model, keys, text_col)
    else:
        # a text without words counts as one
        n_words = F.greatest(F.coalesce(F.regexp_count(F.col(text_col), F.lit(RX_LETTERS)), F.lit(0)), F.lit(1))
        total = df.agg(F.sum(n_words.cast("long")).alias("n")).first()["n"]
        summed = df.select(*keys, model.sums(F.col(text_col)).alias("_sums"))
        per_row = (summed.select(*keys, F.col("_sums.n").alias("_n"), *[F.col(f"_sums.s{i}").alias(c) for i, c in enumerate(sums)])
                         .repartition(_n_parts(df, total), *keys))
    per_text = per_row.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in sums])
    return per_text.select(*keys, _label(model.consts, F.col("_n"), [F.col(c) for c in sums]).alias(out))


def _n_parts(df: DataFrame, n_words: int | None) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(n_words or 0) // WORDS_PER_TASK))


def _word_sums(df: DataFrame, model: LanguageModel, keys: Sequence[str], text_col: str) -> DataFrame:
    """``(*keys, _n, _s0, _s1, ...)``: the vector of each word of the texts, dealt by ``keys``."""
    from tonekit.session import materialize
    # explode_outer keeps texts without words (one row, null word) so no join back is needed
    words = F.explode_outer(word_tokens(text_col)).alias("word")
    counts = materialize(df.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.where(F.col("word").isNotNull()).select("word")
    vectors = materialize(word_vectors(distinct, model.profiles, [lang for lang, _ in model.consts]))
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    # texts are dealt by their keys before they become words: the sum per text needs no second shuffle
    toks = df.select(*keys, text_col).repartition(_n_parts(df, total), *keys).select(*keys, words)
    joined = toks.join(broadcast_if_small(vectors), "word", "left")
    return joined.select(*keys, F.coalesce("n_tri", F.lit(0)).alias("_n"),
                         *[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(len(model.consts))])
