"""Lexicon scorers over sentence rows.

Three independent scores per sentence, all from one lexicon ``(word, valence, polarity, subjectivity)``:

* compound (A):  S = sum of token valences; ``S / sqrt(S^2 + 15)`` rounded to 4 digits, 0 without hits.
  Shares (A): pos = sum(v + 1) over v > 0, neg = sum(1 - v) over v < 0, neu = count of tokens with
  no valence or valence 0; each divided by pos + neg + neu, rounded to 3 digits (0 for no tokens).
  Optional negation (N6): a valence is multiplied by -0.74 when one of the 3 previous tokens is a negator.
* polarity / subjectivity (B): means over tokens that have the value, rounded to 4 digits, 0 without hits.
  (Stored scores have 4 decimals, so their means can be taken exactly with ``exact_mean``.)
* ordinal (C): each token counts as up/down by the sign of sign(valence) + sign(polarity);
  g = 2(up - down) / (up + down + 2) is cut at -1, -0.33, 0.33, 1 into classes 0..4
  (0: g < -1, 1: g < -0.33, 2: g <= 0.33, 3: g <= 1, 4: g > 1), compared in integers.

Token values are summed as exact integers (valence in 1e-8 units, polarity and subjectivity in 1e-4
units; the lexicon has at most 4 decimals and the negation factor 2), and each sum is turned into a
double once, so scores do not depend on evaluation order.

With ``modifiers`` (N6 in full) a valence is first moved by the boosters among the 3 previous tokens
(``BOOST`` in the valence's own direction, dampers against it, 95 % of it two and 90 % three tokens away), then
turned by a negator among them.

One path for any lexicon that a plan can carry (``MAX_PLAN_WORDS``): the words are dealt to buckets of about four
by their hash, and the buckets are a literal array in the plan. A token costs one hash, one index and a
short scan, whether the lexicon has 25 words or 50,000; scoring is one narrow stage without a shuffle, the
text never moves, and a stream has the same layout. Scores leave through a one-row generator so that a later filter
on a score is not pushed below it (which would inline and evaluate the scoring twice).

A lexicon beyond that is first cut to the words that the texts hold (one row per distinct word of the corpus). If what
is left fits the plan, it is scored as above; else tokens are exploded, joined with the lexicon (AQE splits hot words),
aggregated per different text and joined back on a hash of the text (SHA-256).

All take the lexicon from ``_lexicon_units`` and score each input row on its own; a null text has no tokens.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonekit.functions.numeric import round_half_up
from tonekit.functions.text import word_tokens
from tonekit.operators.generate import explode_rows
from tonekit.operators.joins import broadcast_if_small
from tonekit.sources.lexicon import BOOST, BOOSTERS, DAMPERS, DECAY, NEGATION_FACTOR, NEGATION_REACH, NEGATORS

MAX_PLAN_WORDS = 50_000  # lexicon words that a plan carries as literals (a few MB)
BUCKET = 4               # words of a bucket, about
COMPOUND_ALPHA = 15
SCORE_COLUMNS = ("ordinal", "compound", "neu", "neg", "pos", "polarity", "subjectivity")

V_UNIT = 10 ** 8     # valence unit: 1e-8 (lexicon 1e-4, boosts 1e-6, both x negation factor 1e-2)
P_UNIT = 10 ** 4     # polarity / subjectivity unit: 1e-4
NEG_HUNDREDTHS = int(NEGATION_FACTOR * 100)
assert Decimal(NEG_HUNDREDTHS) / 100 == NEGATION_FACTOR, "negation factor must have at most 2 decimals"
V_PER_4 = V_UNIT // P_UNIT               # valence units in 1e-4
BOOSTS = [int(BOOST * d * 10 ** 6) * (V_UNIT // 10 ** 6) for d in DECAY]  # by distance 1, 2, 3
assert [Decimal(b) / V_UNIT for b in BOOSTS] == [BOOST * d for d in DECAY], "boosts must have at most 6 decimals"


def _sign(c: Column) -> Column:
    return F.when(c > 0, F.lit(1)).when(c < 0, F.lit(-1)).otherwise(F.lit(0))


def _hit_parts(v: Column, p: Column, s: Column) -> dict[str, Column]:
    """Integer contributions of one *matched* token (v in 1e-8 units, p and s in 1e-4 units)."""
    zero = F.lit(0).cast("long")
    tone = _sign(F.coalesce(v, zero)) + _sign(F.coalesce(p, zero))
    return {
        "s_val": F.coalesce(v, zero),
        "s_pos": F.when(v > 0, v + F.lit(V_UNIT)).otherwise(zero),
        "s_neg": F.when(v < 0, F.lit(V_UNIT) - v).otherwise(zero),
        "n_nz": F.when(v.isNotNull() & (v != 0), F.lit(1)).otherwise(F.lit(0)),
        "s_pol": F.coalesce(p, zero),
        "n_pol": F.when(p.isNotNull(), F.lit(1)).otherwise(F.lit(0)),
        "s_sub": F.coalesce(s, zero),
        "n_sub": F.when(s.isNotNull(), F.lit(1)).otherwise(F.lit(0)),
        "n_up": F.when(tone > 0, F.lit(1)).otherwise(F.lit(0)),
        "n_down": F.when(tone < 0, F.lit(1)).otherwise(F.lit(0)),
    }


PART_NAMES = ("s_val", "s_pos", "s_neg", "n_nz", "s_pol", "n_pol", "s_sub", "n_sub", "n_up", "n_down")


def _negated(v: Column) -> Column:
    """A valence turned by a negator: exact, as values are multiples of 100 units."""
    return (v / F.lit(100)).cast("long") * F.lit(NEG_HUNDREDTHS)


def _finish(t: dict[str, Column], n_tokens: Column) -> dict[str, Column]:
    """Sentence scores from the integer part sums and the token count."""
    v_unit, p_unit = F.lit(float(V_UNIT)), F.lit(float(P_UNIT))
    s = t["s_val"].cast("double") / v_unit
    compound = round_half_up(s / F.sqrt(s * s + F.lit(float(COMPOUND_ALPHA))), 4)
    n_neu = n_tokens - t["n_nz"]
    total = (t["s_pos"] + t["s_neg"] + n_neu.cast("long") * F.lit(V_UNIT)).cast("double") / v_unit

    def share(x: Column) -> Column:
        return F.coalesce(round_half_up(F.try_divide(x, total), 3), F.lit(0.0))

    def mean(sum_col: Column, n: Column) -> Column:
        return F.coalesce(round_half_up(F.try_divide(sum_col.cast("double") / p_unit, n.cast("double")), 4),
                          F.lit(0.0))

    d = t["n_up"] - t["n_down"]
    m = t["n_up"] + t["n_down"] + F.lit(2)
    ordinal = (F.when(2 * d < -m, F.lit(0))
                .when(200 * d < -33 * m, F.lit(1))
                .when(200 * d <= 33 * m, F.lit(2))
                .when(2 * d <= m, F.lit(3))
                .otherwise(F.lit(4)))
    return {
        "ordinal": ordinal,
        "compound": compound,
        "neu": share(n_neu.cast("double")),
        "neg": share(t["s_neg"].cast("double") / v_unit),
        "pos": share(t["s_pos"].cast("double") / v_unit),
        "polarity": mean(t["s_pol"], t["n_pol"]),
        "subjectivity": mean(t["s_sub"], t["n_sub"]),
    }


def _emit(df: DataFrame, keep: list[str], scores: dict[str, Column]) -> DataFrame:
    """Attach the scores through a one-row generator: filters on them stay above it."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in scores.items()]))
    return df.select(*keep, F.inline(packed))


def negator_marks(tokens: Column) -> Column:
    """``ARRAY<BOOLEAN>``: token is a negator."""
    return F.transform(tokens, lambda t: F.array_contains(F.lit(list(NEGATORS)), t))


def negation_flags(tokens: Column, reach: int = NEGATION_REACH, marks: Column | None = None) -> Column:
    """``ARRAY<BOOLEAN>``, true where one of the ``reach`` previous tokens is a negator.

    Built from shifted copies of the negator marks (O(n)); no lambda looks into another array,
    which would make Catalyst re-evaluate that array for every element. Pass ``marks`` as a staged
    column so the marks are computed once rather than once per shifted copy.
    """
    is_neg = marks if marks is not None else negator_marks(tokens)
    n = F.size(tokens)
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(False), k), is_neg), 1, n) for k in range(1, reach + 1)]
    out = shifted[0]
    for nxt in shifted[1:]:
        out = F.zip_with(out, nxt, lambda a, b: a | b)
    return out


def _lexicon_units(lexicon: DataFrame) -> DataFrame:
    """``word, v4, p4, s4``: values rounded to 1e-4 units, one row per word, for both strategies.

    Of rows with one word the one with the greatest (valence, polarity, subjectivity) wins, null least.
    """
    values = [F.round(F.col(c) * P_UNIT).cast("long").alias(n)
              for c, n in (("valence", "v4"), ("polarity", "p4"), ("subjectivity", "s4"))]
    rows = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.max(F.struct(*values)).alias("u"))
    return rows.select("word", "u.v4", "u.p4", "u.s4")


def _plan_rows(lexicon: DataFrame, limit: int | None = None):
    """Lexicon words in units with their hash if a plan can carry them (bounded read), else None."""
    limit = MAX_PLAN_WORDS if limit is None else limit
    rows = _lexicon_units(lexicon).select("word", "v4", "p4", "s4", F.xxhash64("word").alias("h")).limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def _modifier_rows(lexicon: DataFrame, negation: bool, modifiers: bool) -> dict[str, tuple[int, int, int]]:
    """``word -> (booster sign, is negator, hash)`` of the words that change a later valence."""
    if not (negation or modifiers):
        return {}
    signs = {**dict.fromkeys(BOOSTERS, 1), **dict.fromkeys(DAMPERS, -1)} if modifiers else {}
    words = sorted({*NEGATORS, *signs})
    frame = lexicon.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: (signs.get(r["word"], 0), int(r["word"] in NEGATORS), r["h"])
            for r in frame.select("word", F.xxhash64("word").alias("h")).collect()}


_ENTRY = "struct<w: string, v4: bigint, p4: bigint, s4: bigint, hit: int, boost: int, neg: int>"


def _buckets(entries: Sequence[tuple]) -> tuple[Column, Column, int]:
    """Literal arrays of words and of entries by bucket, and the number of buckets.

    ``entries``: ``(hash, word, v4, p4, s4, hit, boost, neg)``. One JSON text each, which the optimizer folds into a literal.
    """
    n = max(1, -(-len(entries) // BUCKET))
    dealt: list[list[tuple]] = [[] for _ in range(n)]
    for e in sorted(entries, key=lambda e: e[1]):
        dealt[e[0] % n].append(e[1:])
    names = ("w", "v4", "p4", "s4", "hit", "boost", "neg")
    words = F.from_json(F.lit(json.dumps([[e[0] for e in b] for b in dealt])), "array<array<string>>")
    values = F.from_json(F.lit(json.dumps([[dict(zip(names, e)) for e in b] for b in dealt])), f"array<array<{_ENTRY}>>")
    return words, values, n


def _score_inline(df: DataFrame, text_col: str, rows, negation: bool, modifiers: bool = False) -> DataFrame:
    special = _modifier_rows(df, negation, modifiers)
    entries = {r["word"]: (r["h"], r["word"], r["v4"], r["p4"], r["s4"], 1, 0, 0) for r in rows}
    for w, (boost, neg, h) in special.items():
        entries[w] = (*entries.get(w, (h, w, None, None, None, 0))[:6], boost, neg)
    words, values, n = _buckets(list(entries.values()))

    def bucket(t: Column) -> Column:
        return F.pmod(F.xxhash64(t), F.lit(n)).cast("int")

    def known(t: Column) -> Column:
        return F.array_contains(F.get(words, bucket(t)), t)

    def entry(t: Column) -> Column:
        return F.get(F.get(values, bucket(t)), (F.array_position(F.get(words, bucket(t)), t) - 1).cast("int"))

    cols = df.columns
    staged = df.withColumn("_toks", F.coalesce(word_tokens(text_col), F.array().cast("array<string>")))
    zero = [F.lit(0).cast("long").alias(x) for x in PART_NAMES]
    if special:
        # only words that count, with their places; then one pass that remembers the last three
        # boosters and the last negator
        found = F.filter(F.transform(F.col("_toks"), lambda t, i: F.when(known(t), F.struct(i.alias("i"), entry(t).alias("e")))),
                         lambda x: x.isNotNull())
        far = F.lit(-100).cast("int")
        state = F.struct(*zero, *[far.alias(f"at{k}") for k in (1, 2, 3)], *[F.lit(0).alias(f"up{k}") for k in (1, 2, 3)],
                         far.alias("neg_at"))

        def step(acc: Column, x: Column) -> Column:
            i, e = x["i"], x["e"]
            v4 = e["v4"]
            v = v4 * F.lit(V_PER_4)
            if modifiers:
                moved = F.lit(0).cast("long")
                for k in (1, 2, 3):
                    by = F.lit(0).cast("long")
                    for distance, b in enumerate(BOOSTS, 1):
                        by = F.when(i - acc[f"at{k}"] == distance, F.lit(b).cast("long")).otherwise(by)
                    moved = moved + by * acc[f"up{k}"]
                v = v + _sign(v4) * moved
            v = F.when(i - acc["neg_at"] <= NEGATION_REACH, _negated(v)).otherwise(v)
            hit = e["hit"] == 1
            parts = _hit_parts(v, e["p4"], e["s4"])
            sums = [F.when(hit, acc[c] + parts[c]).otherwise(acc[c]).alias(c) for c in PART_NAMES]
            new = e["boost"] != 0
            at = [F.when(new, i).otherwise(acc["at1"])] + [F.when(new, acc[f"at{k - 1}"]).otherwise(acc[f"at{k}"]) for k in (2, 3)]
            up = [F.when(new, e["boost"]).otherwise(acc["up1"])] + [F.when(new, acc[f"up{k - 1}"]).otherwise(acc[f"up{k}"]) for k in (2, 3)]
            return F.struct(*sums, *[c.cast("int").alias(f"at{k}") for k, c in enumerate(at, 1)],
                            *[c.cast("int").alias(f"up{k}") for k, c in enumerate(up, 1)],
                            F.when(e["neg"] == 1, i).otherwise(acc["neg_at"]).cast("int").alias("neg_at"))
    else:
        found = F.transform(F.filter(F.col("_toks"), known), entry)
        state = F.struct(*zero)

        def step(acc: Column, e: Column) -> Column:
            parts = _hit_parts(e["v4"] * F.lit(V_PER_4), e["p4"], e["s4"])
            return F.struct(*[(acc[c] + parts[c]).alias(c) for c in PART_NAMES])

    staged = staged.select(*cols, F.size("_toks").alias("_n"), found.alias("_found"))
    staged = staged.select(*cols, "_n", F.aggregate("_found", state, step).alias("_t"))
    return _emit(staged, cols, _finish({x: F.col("_t")[x] for x in PART_NAMES}, F.col("_n")))


def boost_units(tokens: Column, signs: Column | None = None) -> Column:
    """``ARRAY<BIGINT>``: what the boosters and dampers among the 3 previous tokens add to a valence's size."""
    if signs is None:
        signs = booster_signs(tokens)
    n = F.size(tokens)
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(0), k), signs), 1, n) for k in range(1, len(BOOSTS) + 1)]
    near = F.zip_with(shifted[0], shifted[1], lambda x, y: x * F.lit(BOOSTS[0]).cast("long") + y * F.lit(BOOSTS[1]).cast("long"))
    return F.zip_with(near, shifted[2], lambda x, y: x + y * F.lit(BOOSTS[2]).cast("long"))


def booster_signs(tokens: Column) -> Column:
    """``ARRAY<INT>``: 1 for a booster, -1 for a damper, else 0."""
    return F.transform(tokens, lambda t: F.when(t.isin(*BOOSTERS), 1).when(t.isin(*DAMPERS), -1).otherwise(0))


def _score_exploded(df: DataFrame, text_col: str, lexicon: DataFrame, negation: bool, modifiers: bool = False) -> DataFrame:
    # scores depend on the text alone, so its hash is the key: null and repeated ids cost nothing
    df_keyed = df.withColumn("_key", F.sha2(F.col(text_col), 256))
    texts = df_keyed.where(F.col("_key").isNotNull()).select("_key", F.col(text_col).alias("_text")).dropDuplicates(["_key"])
    toks = texts.select("_key", word_tokens("_text").alias("_toks"))
    if negation or modifiers:
        toks = toks.withColumn("_marks", negator_marks(F.col("_toks")))
        toks = toks.withColumn("_neg", negation_flags(F.col("_toks"), marks=F.col("_marks")))
    else:
        toks = toks.withColumn("_neg", F.transform("_toks", lambda t: F.lit(False)))
    if modifiers:
        toks = toks.withColumn("_signs", booster_signs(F.col("_toks")))
        toks = toks.withColumn("_boost", boost_units(F.col("_toks"), F.col("_signs")))
    else:
        toks = toks.withColumn("_boost", F.transform("_toks", lambda t: F.lit(0).cast("long")))
    pairs = F.arrays_zip(F.col("_toks").alias("word"), F.col("_neg").alias("negated"), F.col("_boost").alias("boost"))
    toks = explode_rows(toks, pairs, ["tok"], ["_key"])
    toks = toks.select("_key", F.col("tok.word").alias("word"), F.col("tok.negated").alias("negated"), F.col("tok.boost").alias("boost"))
    lex = _lexicon_units(lexicon)
    joined = toks.join(broadcast_if_small(lex), "word", "left")
    v = F.col("v4") * F.lit(V_PER_4)
    v = v + _sign(F.col("v4")) * F.col("boost")
    v = F.when(F.col("negated"), _negated(v)).otherwise(v)
    parts = _hit_parts(v, F.col("p4"), F.col("s4"))
    agg = joined.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"),
                                    *[F.sum(c).cast("long").alias(n) for n, c in parts.items()])
    # Sentences without any token have no row in ``agg``: their sums are 0.
    cols = df.columns
    out = df_keyed.join(agg, "_key", "left")
    sums = {n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in parts}
    return _emit(out, cols, _finish(sums, F.coalesce(F.col("_n"), F.lit(0).cast("long"))))


def words_in(df: DataFrame, text_col: str) -> DataFrame:
    """``word``: every distinct token of the texts, counted map-side first."""
    return explode_rows(df, word_tokens(text_col), ["word"]).distinct()


def score_sentences(df: DataFrame, lexicon: DataFrame, text_col: str = "sentence", negation: bool = False,
                    strategy: str = "auto", modifiers: bool = False) -> DataFrame:
    """Add ``ordinal, compound, neu, neg, pos, polarity, subjectivity`` to sentence rows.

    ``modifiers``: boosters, dampers and negators change the valences after them; ``negation``: negators alone.
    ``strategy``: ``auto``, ``inline`` (the plan carries the lexicon, an error if it is too large) or ``exploded``.
    """
    if strategy in ("auto", "inline"):
        rows = _plan_rows(lexicon)
        if rows is None and strategy == "auto":
            rows = _plan_rows(lexicon.join(words_in(df, text_col), "word", "left_semi"))
        if rows is not None:
            return _score_inline(df, text_col, rows, negation, modifiers)
        if strategy == "inline":
            raise ValueError(f"lexicon has more than {MAX_PLAN_WORDS} words; use the exploded strategy")
    return _score_exploded(df, text_col, lexicon, negation, modifiers)


def tokenize(df: DataFrame, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """T13 as rows: ``(*keys, pos, word)`` with 0-based token position."""
    return explode_rows(df, word_tokens(text_col), ["pos", "word"], list(keys), with_pos=True)
