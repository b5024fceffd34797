"""Text -> ranked sentence rows.

One narrow stage: split is a regex over the text, the noise filter is a higher-order ``filter`` on
the sentence array and ``posexplode`` numbers what is left, so ranks are taken *after* filtering.
Document metadata is carried through the same ``select``; no join back to the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonekit.functions.patterns import RX_NOISE, RX_SENT, SENT_MARK
from tonekit.functions.text import strip
from tonekit.operators.generate import explode_rows

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_sentences(text: ColumnOrName) -> Column:
    """Sentences of a text as ``ARRAY<STRING>``; whitespace-only pieces are dropped."""
    marked = F.regexp_replace(_col(text), RX_SENT, "$1" + SENT_MARK)
    pieces = F.transform(F.split(marked, SENT_MARK), lambda s: strip(s))
    return F.filter(pieces, lambda s: s != F.lit(""))


def is_noise(sentence: ColumnOrName) -> Column:
    """stage directions such as ``(Applause.)`` and sentences starting with ``.``."""
    return _col(sentence).rlike(RX_NOISE)


def drop_noise_sentences(df: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """F7 as a row filter."""
    return df.where(~is_noise(sentence_col))


def explode_sentences(df: DataFrame, id_col: str, text_col: str, sentence_level: int = 1,
                      keep: Sequence[str] = (), with_count: bool = False) -> DataFrame:
    """One row per sentence ``(id, rank_sentence, sentence, *keep)``.

    ``sentence_level=1``: split (N1), drop noise (F7), then rank 0.. in text order.
    ``sentence_level=0``: the whole text is one sentence with rank 0, nothing is dropped.
    A null text gives no rows. ``with_count`` adds ``n_sentences`` (sentences of the same text),
    known before the explode, so per-document progress needs no shuffle.
    """
    text = F.col(text_col)
    if sentence_level == 1:
        parts = F.filter(split_sentences(text), lambda s: ~is_noise(s))
    else:
        parts = F.when(text.isNotNull(), F.array(text))
    staged = df.select(F.col(id_col).alias("id"), *[F.col(k) for k in keep], parts.alias("_parts"))
    extra = [F.size("_parts").alias("n_sentences")] if with_count else []
    out = explode_rows(staged, F.col("_parts"), ["rank_sentence", "sentence"], ["id", *keep, *extra], with_pos=True)
    return out.select("id", "rank_sentence", "sentence", *keep, *[c for c in ("n_sentences",) if with_count])
