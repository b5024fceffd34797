"""Scoring lexicon: a small reference table (word -> valence, polarity, subjectivity).

Scorers follow whatever lexicon they are given; the rows below are the test fixture (invented words
for the four corpus languages, no meaning in any real language). Valence feeds the compound score,
polarity and subjectivity feed the polarity score, and the signs of both feed the ordinal score.
The two value columns differ on purpose: with one shared column the scorers would never disagree.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

# Exact decimal values: sums over tokens are exact, so results do not depend on summation order.
LEX_DEC = DecimalType(18, 4)

LEXICON_SCHEMA = StructType([
    StructField("word", StringType(), False),
    StructField("valence", LEX_DEC, True),
    StructField("polarity", LEX_DEC, True),
    StructField("subjectivity", LEX_DEC, True),
])

# --- fixed values: fixture lexicon, one "word,valence,polarity,subjectivity" per line (blank = none) ---
FIXTURE_LEXICON_TEXT = """\
for,1.9,,
with,1.2,0.3,0.5
this,0.8,-0.2,0.4
on,0.6,0.1,0.2
was,-1.1,-0.3,0.6
at,-0.7,,
from,-1.6,-0.5,0.9
by,-0.9,0.2,0.3
as,,0.4,0.7
it,,-0.1,0.1
für,1.5,0.4,0.6
mit,0.9,,
das,,0.2,0.3
von,-0.8,0.1,0.2
auf,-1.2,-0.4,0.8
pour,1.4,0.3,0.5
avec,1.1,,
dans,0.5,-0.2,0.3
sur,-1.0,-0.3,0.7
par,,0.2,0.4
con,1.3,0.4,0.6
para,1.0,-0.1,0.2
los,,0.1,0.3
por,-1.1,-0.3,0.5
del,-0.5,,
"""
# Negation of the compound score: a token is flipped and damped when one of the previous
# NEGATION_REACH tokens is a negator.
NEGATORS = ("not", "nicht", "pas", "no")
NEGATION_FACTOR = Decimal("-0.74")
NEGATION_REACH = 3
# Boosters move the valence of one of the next three words by BOOST in its own direction, dampers against it; a word
# two or three places away takes the second and third share of DECAY. Invented for the four corpus languages.
BOOSTERS = ("that", "und", "que", "les")
DAMPERS = ("be", "zu", "des", "las")
BOOST = Decimal("0.293")
DECAY = (Decimal("1"), Decimal("0.95"), Decimal("0.9"))
# --- end of fixed values ---


def _num(text: str) -> Decimal | None:
    return Decimal(text) if text.strip() else None


def parse_lexicon_text(text: str) -> list[tuple[str, Decimal | None, Decimal | None, Decimal | None]]:
    rows = []
    for line in text.splitlines():
        if not line.strip():
            continue
        word, valence, polarity, subjectivity = line.split(",")
        rows.append((word, _num(valence), _num(polarity), _num(subjectivity)))
    return rows


def fixture_lexicon(spark: SparkSession) -> DataFrame:
    """The fixture lexicon as a DataFrame (reference rows built on the driver, 25 rows)."""
    return spark.createDataFrame(parse_lexicon_text(FIXTURE_LEXICON_TEXT), LEXICON_SCHEMA)


def read_lexicon(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A lexicon stored as a headered delimited file with the columns of ``LEXICON_SCHEMA``."""
    return (spark.read.schema(LEXICON_SCHEMA).option("header", True).option("sep", sep)
            .csv(path))


def induced_lexicon(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    label_col: str = "quality", least: int = 3) -> DataFrame:
    """A lexicon learned from labelled documents: every word that at least ``least`` of them hold.

    With g documents of label 1 and b of label 0 that hold a word, its polarity is (g - b) / (g + b), its valence four
    times that and its subjectivity the size of it, with four decimals. Distinct (document, word) pairs are
    counted per word with map-side combine; labels are joined before any text is split.
    """
    from tonekit.functions.text import word_tokens
    from tonekit.operators.generate import explode_rows
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, label_col)
    words = explode_rows(docs.select(id_col, text_col).join(known, id_col), F.array_distinct(word_tokens(text_col)),
                         ["word"], [label_col])
    counts = words.groupBy("word").agg(F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("g"), F.count(F.lit(1)).alias("n"))
    tilt = (F.lit(2) * F.col("g") - F.col("n")).cast("double") / F.col("n")

    def units(x):  # half up in units of 1e-4, the same in any engine
        return (F.floor(x * F.lit(10000.0) + F.lit(0.5)).cast("decimal(14,0)") / F.lit(10000).cast("decimal(5,0)")).cast(LEX_DEC)

    return counts.where(F.col("n") >= least).select(
        "word", units(tilt * 4.0).alias("valence"), units(tilt).alias("polarity"), units(F.abs(tilt)).alias("subjectivity"))


def lexicon_values_sql(text: str = FIXTURE_LEXICON_TEXT) -> str:
    """The lexicon as a SQL ``VALUES`` list (for oracle queries in other engines)."""
    def lit(v):
        return "NULL" if v is None else f"CAST({v} AS DECIMAL(18,4))"
    rows = [f"('{w}', {lit(a)}, {lit(b)}, {lit(c)})" for w, a, b, c in parse_lexicon_text(text)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(word, valence, polarity, subjectivity)"
