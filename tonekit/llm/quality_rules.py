"""Operator 8: quality rules, a table of thresholds compiled into one projection.

``measures`` computes lengths, symbols, stop words and line ratios of whole texts with built-in
functions only; ``verdict`` turns ``RULES`` (measure, least, most) into one boolean column. Nothing is
shuffled: a text is judged by itself, and its words are kept in one array column that the
expressions read (a one-row generator keeps Spark from building the array again for each of them).

Repeated words: the 8-word windows are hashed, the hashes sorted, and the places of those that occur
again swept once, so a text of n words takes n log n steps.

Defined results: a null or empty text has no words and fails the base (fewer than 20 words); a ratio
over nothing is 0; equal rows are judged alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import SPACES, WORD, table

#: Characters that count as symbols, words of a window, limits of the base.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Frequent words of English, German, Spanish and French.
STOP_WORDS = ("the be to of and that have with in is it for on as by an a was are this "
              "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
              "de la que el en y los se del las un por con no una su para es al lo "
              "le les et des du est pour qui dans au pas sur ne plus par avec ou").split()
#: The rules: a measure with its least and most value.
RULES = (
    ("mean_word_length", 2.0, 15.0),
    ("symbols_per_word", 0.0, 0.3),
    ("stop_word_ratio", 0.02, 1.0),
    ("capital_ratio", 0.0, 0.4),
    ("shout_ratio", 0.0, 0.2),
    ("bullet_line_ratio", 0.0, 0.9),
    ("ellipsis_line_ratio", 0.0, 0.3),
    ("dup_line_ratio", 0.0, 0.5),
)


def _staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns that later expressions read as they are."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts and the measures that the rules are about."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    filled = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    df = _staged(df, ["doc_id", "text"], words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lines=filled)
    n = F.size("words")
    stops = F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.slice("words", i, WINDOW)).alias("h"), i.alias("at"))))
    df = _staged(
        df, ["doc_id"], n_words=n.cast("long"), word_chars=F.length(_without(F.col("text"), SPACES)).cast("long"),
        n_symbols=(F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long"),
        n_lines=F.size("lines").cast("long"), n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_stop=stops, n_capital=F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")),
        n_letters=F.length(F.regexp_replace("text", r"\P{L}+", "")), n_shout=F.length("text") - F.length(_without(F.col("text"), "!")),
        n_bullet=F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))),
        n_ellipsis=F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))),
        sorted=F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,at:int>>"))))
    rest = [c for c in df.columns if c != "sorted"]
    twice = F.filter("sorted", lambda x, k: (F.get("sorted", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("sorted", k + 1)["h"].eqNullSafe(x["h"])))
    df = _staged(df, rest, places=F.sort_array(F.transform(twice, lambda x: x["at"])))
    # words covered by the windows, which are in order: each adds what lies behind the one before
    swept = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda acc, at: F.struct(
        (acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"), (at + WINDOW).alias("end")))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", swept["n"].alias("n_repeat_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("n_stop"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_capital"), F.col("n_letters")).alias("capital_ratio"),
        _ratio(F.col("n_shout"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("n_bullet"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"))


def verdict(rules: tuple = RULES) -> Column:
    """The table of rules as one column: true where every measure lies within its limits."""
    return reduce(Column.__and__, [F.col(m).between(least, most) for m, least, most in rules], F.lit(True))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base failure and the verdict of every document."""
    rows = measures(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & verdict()).alias("kept"))


def _oracle() -> str:
    """The same in SQL: windows as rows, one filter per line ratio, the table of rules as conditions."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0::DOUBLE END"
    measured = {
        "mean_word_length": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop", "n_words"), "capital_ratio": ratio("n_capital", "n_letters"),
        "shout_ratio": ratio("n_shout", "n_words"), "bullet_line_ratio": ratio("n_bullet", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis", "n_lines"), "dup_line_ratio": ratio("n_dup_lines", "n_lines")}
    good = " AND ".join(f"({measured[m]}) BETWEEN {least!r}::DOUBLE AND {most!r}::DOUBLE" for m, least, most in RULES)
    failed = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS ls FROM d),
    i AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
    k AS (SELECT r, i, ws[i:i + {WINDOW - 1}] AS k FROM i),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k),
    p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM c WHERE c > 1) GROUP BY r),
    m AS (SELECT doc_id, len(ws) AS n_words, length(translate(t, {spaces}, '')) AS word_chars,
                 length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
                 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
                 len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop,
                 length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capital, length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters,
                 length(t) - length(translate(t, '!', '')) AS n_shout,
                 len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullet,
                 len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS n_ellipsis FROM w LEFT JOIN p USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
           NOT ({failed}) AND {good} AS kept FROM m"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {"op8_quality_rules": _oracle()}
