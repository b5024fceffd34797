"""The scored sentence table (N10): text table -> one row per sentence with three scores.

Plan shape (inline lexicon): scan -> split/filter/posexplode -> language -> token scores, all in one narrow
stage with the document metadata carried along (no join back to the documents, no shuffle of sentences).
Only documents whose id comes more than once need more: the language belongs to ``(id, rank_sentence)``, so their sentences are
summed up by that key and joined. The ids are counted first (one short row per document).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonekit.operators.joins import broadcast_if_small, is_small
from tonekit.operators.language import LanguageModel, detect_language, language_model, with_language
from tonekit.operators.scoring import SCORE_COLUMNS, score_sentences
from tonekit.operators.sentences import explode_sentences
from tonekit.session import materialize


def sentiment_table(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                    sentence_level: int = 1, keep: Sequence[str] = (), negation: bool = False,
                    profiles: DataFrame | None = None) -> DataFrame:
    """``(id, rank_sentence, sentence, ordinal, compound, neu, neg, pos, polarity, subjectivity,
    [language], *keep)``.

    ``sentence_level=1`` splits texts into ranked sentences (noise dropped before ranking);
    ``0`` scores each whole text as one row with rank 0. ``profiles`` (from ``build_profiles``)
    adds the ``language`` column.
    """
    sents = explode_sentences(df, id_col, text_col, sentence_level, keep)
    cols = ["id", "rank_sentence", "sentence", *SCORE_COLUMNS]
    if profiles is not None:
        def split(docs: DataFrame) -> DataFrame:
            return explode_sentences(docs, id_col, text_col, sentence_level, keep)

        sents = _with_key_language(df, id_col, split, language_model(profiles))
        cols.append("language")
    return score_sentences(sents, lexicon, negation=negation).select(*cols, *keep)


def _with_key_language(df: DataFrame, id_col: str, split: Callable[[DataFrame], DataFrame], model: LanguageModel) -> DataFrame:
    """The sentences of ``df`` with the ``language`` of their ``(id, rank_sentence)``: of the sentences that share it together, null without id."""
    def by_key(docs: DataFrame) -> DataFrame:
        sents = split(docs)
        return sents.join(detect_language(sents.where(F.col("id").isNotNull()), model), ["id", "rank_sentence"], "left")

    def by_row(docs: DataFrame) -> DataFrame:
        sents = split(docs)
        labelled = with_language(sents, model)
        return labelled.withColumn("language", F.when(F.col("id").isNotNull(), F.col("language")))

    if model.sums is None:
        return by_key(df)
    repeated = materialize(df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
                             .where(F.col("_n") > 1).select(id_col))
    if repeated.isEmpty():
        return by_row(df)
    if not is_small(repeated):
        return by_key(df)
    few = F.broadcast(repeated)
    return by_row(df.join(few, id_col, "left_anti")).unionByName(by_key(df.join(few, id_col, "left_semi")))


TURNS = 1 << 20


def conversation_posts(conversations: DataFrame) -> DataFrame:
    """Conversation turns as posts: ``post_id = conv_id * TURNS + turn``, ``author`` = role.

    No two posts share an id: a turn that does not fit, or an id too large for a long, is an error, never another post's id.
    """
    fits = F.col("turn").isNull() | F.col("turn").between(0, TURNS - 1)
    turn = F.when(fits, F.col("turn")).otherwise(F.raise_error(F.lit("a conversation has a turn beyond the range of post ids")).cast("long"))
    return conversations.select(
        (F.col("conv_id") * TURNS + turn).alias("post_id"),
        F.col("role").alias("author"), "text")


def score_posts(posts: DataFrame, lexicon: DataFrame, per_author: int | None = None) -> DataFrame:
    """Post corpus end to end: links, hashtags and mentions removed (T6), duplicates within an author
    dropped keeping the first id (U4), then each post scored as one text (N10 with
    ``sentence_level=0``). All posts are taken, unless ``per_author`` asks for the newest ones (W6).

    ``posts(post_id, author, text)``. Dedup is a ``min_by`` aggregate, so an author with a third of
    all posts is never handled by a single task.
    """
    from tonekit.functions.text import clean_post
    from tonekit.operators.clean import dedupe
    from tonekit.operators.windows import top_n_per_group
    if per_author is not None:
        posts = top_n_per_group(posts, "author", "post_id", per_author).drop("rank")
    cleaned = posts.withColumn("text", clean_post("text"))
    unique = dedupe(cleaned, ["author", "text"], "post_id")
    return sentiment_table(unique, "post_id", "text", lexicon, 0, keep=["author"])
