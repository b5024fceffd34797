"""Operator 9: chat formatting by quotation linking.

A message's leading ``>`` marks give each line a quote level; lines of one level in a row are one
passage. A line that announces quoted ones (ends in ``wrote:`` and the next line has a higher level) is
left out of the passage of its level, or of the message. Passages and every message's own text (its
lines of level 0) are split into units: whole, parts between announcing lines, paragraphs, lines; units are
normalised (marks and white space apart, lower case) and hashed. Of the earlier messages of its conversation that
hold units it quotes, a message answers one at the lowest level that has any: the one with most different
units, of several the latest; without any, the message before it. Quoted lines are left out of the message.

The result is one row per message with its place in the tree of answers: the message it answers, the root of its chain and its
depth. Whoever answers comes later, so turns are a reply order. A conversation is never gathered in one task: links are joins on (conversation,
hash), and the message before a message is found within pieces of ``PIECE`` turns, whose last turns
are compared in a table of one row per piece.

Defined results: a null text is empty; a message with nothing but quotes has empty content;
unknown quotes are removed and link nothing; a quote never links to its own or a later turn; rows
with equal conversation and turn are separate messages that answer the same one; messages with
null conversation or turn answer nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

PIECE = 256
#: Marks of a quoted line, the line that announces a quotation, marks of the output.
QUOTED = r"^[ \t]*(?:>[ \t]?)+"
ANNOUNCES = r"(?i)^.{0,200}\bwrote:\s*$"
ANNOUNCED = r"(?im)^.{0,200}\bwrote:[ \t]*$"
OPEN, CLOSE = "<|", "|>"


def _staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s>]+", " ")))


def _announced(x: Column, k: Column) -> Column:
    says = (F.coalesce(F.get("lines", k + 1)["level"], F.lit(0)) > x["level"]) & x["text"].rlike(ANNOUNCES)
    return F.struct(F.when(says, 0).otherwise(x["level"]).alias("level"), x["text"].alias("text"), says.alias("announces"))


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content, quotes``: own text, and quoted passages with their levels."""
    rows = messages.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\r?\n").alias("raw"))
    lines = F.transform("raw", lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTED, "").alias("text")))
    rows = _staged(rows, ["conv_id", "turn", "role"], lines=lines)
    # an announcing line ends the passage before it, as a line of level 0 does
    rows = _staged(rows, ["conv_id", "turn", "role"], lines=F.transform("lines", lambda x, k: _announced(x, k)))
    own = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["announces"]), lambda x: x["text"])
    content = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    # passages: lines of one level in a row; a passage begins where the level differs from the line before
    rows = _staged(rows, ["conv_id", "turn", "role", "lines"], content=content, starts=F.filter(F.transform(
        "lines", lambda x, k: F.when((k == 0) | (F.get("lines", k - 1)["level"] != x["level"]), k)), lambda k: k.isNotNull()))
    spans = F.zip_with("starts", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines"))),
                       lambda k, end: F.slice("lines", k + 1, end - k))
    quotes = F.transform(F.filter(spans, lambda p: F.get(p, F.lit(0))["level"] > 0), lambda p: F.struct(
        F.get(p, F.lit(0))["level"].alias("level"), F.array_join(F.transform(p, lambda x: x["text"]), "\n").alias("text")))
    return _staged(rows, ["conv_id", "turn", "role", "content"], quotes=quotes)


def _units(text: Column) -> Column:
    """Hashes of a text's units: whole, between announcing lines, by paragraph and by line."""
    parts = F.concat(F.array(text), F.split(text, ANNOUNCED), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _before(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, previous``: the turn before each turn of a conversation."""
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    turns = turns.withColumn("piece", F.floor(F.col("turn") / PIECE))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "piece").orderBy("turn"))
    last = turns.groupBy("conv_id", "piece").agg(F.max("turn").alias("last"))
    # a row per PIECE turns of a conversation
    last = last.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("piece"))).drop("last")
    return turns.withColumn("inside", inside).join(last, ["conv_id", "piece"]).select(
        "conv_id", "turn", F.coalesce("inside", "before").alias("previous"))


def threads(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, root, depth`` of every turn that answers one (``conv_id, turn, reply_to``): the turn at which its chain of
    answers begins and the number of answers up to it. Pointer jumping: a round doubles what a turn knows of its chain."""
    jump = answers.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("root"))
    jump, k = staged(jump.withColumn("depth", F.lit(1).cast("long")), "jump0"), 0
    while True:
        on = jump.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        longer = jump.join(on, ["conv_id", "root"], "left")
        if longer.where("further IS NOT NULL").isEmpty():
            return jump
        k += 1
        jump = staged(longer.select("conv_id", "turn", F.coalesce("further", "root").alias("root"),
                                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"jump{k}")


def linked(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content, n_quotes, max_level, quoted_turn, reply_to, root, depth, formatted``."""
    rows = parsed(messages).withColumn("row", F.xxhash64("role", "content", F.to_json("quotes")))
    rows = staged(rows, "messages")
    sources = (rows.where("content <> ''").select("conv_id", "turn", F.explode(_units(F.col("content"))).alias("hash")))
    quotes = (rows.where(F.size("quotes") > 0)
                  .select("conv_id", "turn", "row", F.explode("quotes").alias("q"))
                  .select("conv_id", F.col("turn").alias("at"), "row", F.col("q.level").alias("level"),
                          F.explode(_units(F.col("q.text"))).alias("hash")).distinct())
    # only hashes that are quoted, each with the turns that hold it; a join, never all pairs of a conversation
    found = (quotes.join(sources.distinct(), ["conv_id", "hash"]).where("turn < at")
                   .groupBy("conv_id", "at", "row", "level", "turn").agg(F.count(F.lit(1)).alias("units"))
                   .groupBy("conv_id", "at", "row").agg(F.min_by("turn", F.struct(
                       "level", -F.col("units"), -F.col("turn"))).alias("quoted_turn")))
    found = found.withColumnRenamed("at", "turn")
    before = _before(rows)
    out = rows.join(before, ["conv_id", "turn"], "left").join(found, ["conv_id", "turn", "row"], "left")
    out = staged(out.withColumn("reply_to", F.coalesce("quoted_turn", "previous")), "answers")
    out = out.join(threads(out.select("conv_id", "turn", "reply_to")), ["conv_id", "turn"], "left")
    level = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0))
    return out.select(
        "conv_id", "turn", "role", "content", F.size("quotes").alias("n_quotes"), level.alias("max_level"), "quoted_turn",
        "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE + "\n"), "content", F.lit("\n" + OPEN + "end" + CLOSE)).alias("formatted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, each with the message it answers."""
    return linked(table(spark, sf_dir, "conversations"))


QUERIES = {"op9_chat": op9_chat}
ORACLES: dict[str, str] = {}
