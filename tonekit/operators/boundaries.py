"""Sentence boundaries learned from the corpus itself (N1), without labels, as in Kiss and Strunk (2006).

Two kinds of words are found from counts over whitespace-separated tokens, with Dunning's log-likelihood ratios:

* abbreviations: words that come with a final period far more often than chance. The ratio compares the
  share of periods among all tokens with a share of 0.99; it is scaled by exp(-length), by the periods inside the word plus one,
  and by length ** -(occurrences without period). 0.3 or more makes an abbreviation.
* starters: words that follow a sentence-ending period more often than they occur elsewhere, ratio 30 or more.

A split at a single period is then taken back after an abbreviation or an initial, unless a starter follows, and after a
number before a small letter (an ordinal). Exclamation and question marks and runs of periods always end a sentence.

Counting is one aggregate per kind with map-side combine: one row per distinct word leaves a task. The table that the split
needs holds these words only; the plan carries it as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonekit.functions.patterns import RX_SENT, SENT_MARK
from tonekit.functions.text import let, strip
from tonekit.operators.generate import explode_rows
from tonekit.operators.scoring import MAX_PLAN_WORDS
from tonekit.operators.sentences import is_noise

# --- fixed values: the published thresholds ---
ABBREVIATION_SHARE, ABBREVIATION_SCORE, STARTER_RATIO = 0.99, 0.3, 30.0
# --- end of fixed values ---
RX_LEAD, RX_TAIL = r"""^["'(\[]+""", r"""["')\]]+$"""
RX_TYPE = r"^\p{L}[\p{L}.]*$"


def _trimmed(text: Column) -> Column:
    """``strip``, with its pattern run only where other white space than ASCII's is left at an end."""
    return let(F.btrim(text, F.lit(" \t\n\x0b\f\r")), lambda t: F.when(
        F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), strip(t)).otherwise(t))


def raw_tokens(text: Column) -> Column:
    """``ARRAY<STRUCT<raw, before>>`` of the lower-cased whitespace-separated tokens; ``before``: the token in front if it has a period."""
    def paired(tokens: Column) -> Column:
        follows = F.concat(F.array(F.lit(None).cast("string")), F.slice(tokens, F.lit(1), F.size(tokens) - 1))
        return F.zip_with(tokens, follows, lambda t, b: F.struct(t.alias("raw"), F.when(F.contains(b, F.lit(".")), b).alias("before")))
    return let(F.split(F.lower(_trimmed(text)), r"\s+"), paired)


def token_type(raw: Column) -> tuple[Column, Column]:
    """Type of a raw token (quotes and brackets at either end and one final period taken off), and whether there was one
    period (not a run of them)."""
    bare = F.regexp_replace(F.regexp_replace(raw, RX_LEAD, ""), RX_TAIL, "")
    period = bare.rlike(r"[^.]\.$")
    return F.when(period, F.regexp_replace(bare, r"\.$", "")).otherwise(bare), period


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def _binomial(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of ``k`` out of ``n`` at probability ``p`` (0 log 0 = 0)."""
    return (F.when(k > 0, k * _log(p)).otherwise(F.lit(0.0)) + F.when(n - k > 0, (n - k) * _log(F.lit(1.0) - p)).otherwise(F.lit(0.0)))


def boundary_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, kind, score``: the abbreviations and the sentence starters of a corpus."""
    from tonekit.session import materialize
    tokens = explode_rows(docs.where(F.col(text_col).isNotNull()), raw_tokens(F.col(text_col)), ["t"]).select("t.*")
    # distinct pairs of raw tokens first: they are few, so the patterns run on few rows
    raw = tokens.groupBy("raw", "before").agg(F.count(F.lit(1)).alias("n"))
    (kind, period), (after, ended) = token_type(F.col("raw")), token_type(F.col("before"))
    pairs = raw.select(kind.alias("type"), F.when(ended, after).alias("after"), "n", F.when(period, F.col("n")).otherwise(0).alias("np"))
    counts = materialize(pairs.groupBy("type", "after").agg(F.sum("n").alias("n"), F.sum("np").alias("np")))
    per_type = counts.groupBy(F.col("type").alias("word")).agg(F.sum("n").cast("double").alias("n"), F.sum("np").cast("double").alias("np"))
    per_type = materialize(per_type)
    total = per_type.agg(F.sum("n").alias("n_all"), F.sum("np").alias("np_all"))  # one row
    scored = per_type.where(F.col("word").rlike(RX_TYPE) & (F.col("np") > 0)).crossJoin(F.broadcast(total))
    k, n = F.col("np"), F.col("n")
    ratio = F.lit(-2.0) * (_binomial(k, n, F.col("np_all") / F.col("n_all")) - _binomial(k, n, F.lit(ABBREVIATION_SHARE)))
    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = (F.length("word") - dots).cast("double")
    score = ratio * F.exp(-size) * (dots + 1) * F.pow(size, k - n)
    abbreviations = scored.select("word", score.alias("score")).where(F.col("score") >= ABBREVIATION_SCORE)
    abbreviations = materialize(abbreviations)
    # what follows a period that ends no abbreviation
    ends = counts.where(F.col("after").isNotNull()).join(abbreviations.select(F.col("word").alias("after")), "after", "left_anti")
    follow = ends.groupBy(F.col("type").alias("word")).agg(F.sum("n").cast("double").alias("k"))
    n_ends = ends.agg(F.sum("n").cast("double").alias("n_ends"))
    rows = (follow.join(per_type.select("word", F.col("n").alias("n_word")), "word").where(F.col("word").rlike(r"^\p{L}+$"))
                  .crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n_ends)))
    k, a, b, n = F.col("k"), F.col("n_ends"), F.col("n_word"), F.col("n_all")
    apart = F.lit(-2.0) * (_binomial(k, a, b / n) + _binomial(b - k, n - a, b / n) - _binomial(k, a, k / a)
                           - _binomial(b - k, n - a, (b - k) / F.greatest(n - a, F.lit(1.0))))
    starters = rows.where((apart >= STARTER_RATIO) & (k / a > b / n)).select("word", F.lit("starter").alias("kind"), apart.alias("score"))
    return abbreviations.select("word", F.lit("abbreviation").alias("kind"), "score").unionByName(starters)


def known_words(statistics: DataFrame) -> tuple[list[str], list[str]]:
    """Abbreviations and starters of a stored table of statistics, as the split needs them."""
    rows = statistics.select("word", "kind").limit(MAX_PLAN_WORDS + 1).collect()
    if len(rows) > MAX_PLAN_WORDS:
        raise ValueError(f"more than {MAX_PLAN_WORDS} boundary words: keep those with the highest scores")
    return tuple(sorted(r["word"] for r in rows if r["kind"] == kind) for kind in ("abbreviation", "starter"))


def split_learned(text: Column, abbreviations: list[str], starters: list[str]) -> Column:
    """Sentences of a text, split by rule and joined again at periods that end none."""
    def ends(piece: Column, following: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(following, r"^\s*(\S+)", 1), RX_LEAD, "")  # read for few pieces only
        starts = F.regexp_extract(F.lower(head), r"^\p{L}+", 0).isin(*starters) if starters else F.lit(False)

        def taken_back(bare: Column) -> Column:
            short = bare.rlike(r"^\p{L}$")
            if abbreviations:
                short = short | bare.isin(*abbreviations)
            return (short & ~starts) | (bare.rlike("^[0-9]+$") & head.rlike(r"^\p{Ll}"))

        last = F.lower(F.regexp_replace(F.regexp_extract(piece, r"(?<!\S)(\S++)\s*$", 1), RX_LEAD, ""))
        return let(last, lambda word: ~word.rlike(r"[^.]\.$") | ~let(F.regexp_replace(word, r"\.$", ""), taken_back))

    def joined(pieces: Column) -> Column:
        after = F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, after, lambda p, q: F.when(ends(p, q), F.concat(p, F.lit(SENT_MARK))).otherwise(p)), "")

    cut = F.split(F.regexp_replace(text, RX_SENT, "$0" + SENT_MARK), SENT_MARK)
    parts = F.transform(F.split(let(cut, joined), SENT_MARK), _trimmed)
    return F.filter(parts, lambda s: s != F.lit(""))


def explode_learned(df: DataFrame, id_col: str, text_col: str, statistics: DataFrame) -> DataFrame:
    """``(id, rank_sentence, sentence)`` with learned boundaries; ``statistics`` should be a stored table."""
    parts = F.filter(split_learned(F.col(text_col), *known_words(statistics)), lambda s: ~is_noise(s))
    return explode_rows(df, parts, ["rank_sentence", "sentence"], [F.col(id_col).alias("id")], with_pos=True)
