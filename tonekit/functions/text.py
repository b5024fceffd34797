"""String, date and token expressions (Column -> Column); all run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonekit.functions.patterns import (
    OPEN_END_TEXT, OPEN_END_YEAR, RX_BOILER, RX_FOOTNOTE, RX_LETTERS, RX_POST, RX_RSTRIP, RX_STRIP,
)

ColumnOrName = Column | str

# --- fixed values: words of dates ---
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_WORDS = ("of", "the", "on", "st", "nd", "rd", "th", "ad", "a", "d",
              "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
              "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun")
# --- end of fixed values ---
#: Months by name and by any beginning of three letters or more.
MONTH_NAMES = {m[:k]: str(i) for i, m in enumerate(MONTHS, 1) for k in range(3, len(m) + 1)}
#: A time of day at the end, with a zone or without.
RX_TIME = r"(?:[t,]|\s|\bat\b)+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})?$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """T5: remove leading and trailing whitespace of any kind (``str.strip``)."""
    return F.regexp_replace(_col(c), RX_STRIP, "")


def rstrip(c: ColumnOrName) -> Column:
    """T5: remove trailing whitespace of any kind (``str.rstrip``)."""
    return F.regexp_replace(_col(c), RX_RSTRIP, "")


def strip_brackets(c: ColumnOrName) -> Column:
    """Drop bracketed footnote marks; greedy, so ``x[a]y[b]z`` becomes ``xz``."""
    return F.regexp_replace(_col(c), RX_FOOTNOTE, "")


def replace_names(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Apply regex -> replacement pairs in order."""
    return reduce(lambda acc, kv: F.regexp_replace(acc, kv[0], kv[1]), mapping.items(), _col(c))


def space_after_dot(c: ColumnOrName) -> Column:
    """Literal replacement of every ``.`` by ``. ``."""
    return F.replace(_col(c), F.lit("."), F.lit(". "))


def clean_transcript(c: ColumnOrName) -> Column:
    """T4: boilerplate word and newlines become a blank."""
    return F.regexp_replace(_col(c), RX_BOILER, " ")


def clean_post(c: ColumnOrName) -> Column:
    """Remove links, hashtags and mentions, then strip."""
    return strip(F.regexp_replace(_col(c), RX_POST, ""))


def split_part(c: ColumnOrName, delimiter: str, n: int) -> Column:
    """N-th (1-based) part of a delimited string, stripped; null when the part is missing."""
    part = F.split_part(_col(c), F.lit(delimiter), F.lit(n))
    return F.nullif(strip(part), F.lit(""))


def parse_date(c: ColumnOrName) -> Column:
    """A date from free-form text, read once; null for text that is none (never an error).

    The text is cut into words and numbers. With a month's name (or its first three letters or more), the first other number
    of one or two digits is the day and the one left the year, in any order: ``March 4, 1885``, ``4th of Mar. 1885``; without a day
    the first is meant. Numbers alone are ``1885-3-4``, ``4.3.1885`` (day first), ``3/4/1885`` (month first, unless it can't
    be one), ``18850304`` or a year. Two-digit years are 1969 to 2068. A time behind the date plays no part;
    weekdays and words like "of" are passed over, any other word makes it no date.
    """
    def read(text: Column) -> Column:
        words = F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.isin(*DATE_WORDS))
        numbers = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
        months = F.create_map(*[F.lit(x) for pair in MONTH_NAMES.items() for x in pair])
        marks = F.regexp_extract(text, "^[0-9]+([^0-9]*)", 1)

        def built(parts: Column) -> Column:
            w, n, mark = parts["w"], parts["n"], parts["mark"]
            a, b, d = (F.get(n, F.lit(i)) for i in range(3))
            la, lb = F.length(a), F.length(b)
            named = F.try_element_at(months, F.get(w, F.lit(0)))
            first = F.lit("1")
            by_name = (F.when((F.size(n) == 1) & (la >= 3), _ymd(a, named, first))
                        .when((F.size(n) == 2) & (la >= 3), _ymd(a, named, b))
                        .when(F.size(n) == 2, _ymd(b, named, a)))
            swap = b.try_cast("int") > 12
            by_number = (F.when((F.size(n) == 1) & (la == 4), _ymd(a, first, first))
                          .when((F.size(n) == 1) & (la == 8), _ymd(F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2)))
                          .when((F.size(n) == 3) & (la >= 3), _ymd(a, b, d))
                          .when((F.size(n) == 3) & F.contains(mark, F.lit(".")), _ymd(d, b, a))
                          .when((F.size(n) == 3) & ~swap & (a.try_cast("int") > 12), _ymd(d, b, a))
                          .when(F.size(n) == 3, _ymd(d, a, b)))
            return F.when((F.size(w) == 1) & named.isNotNull(), by_name).when(F.size(w) == 0, by_number)

        return let(F.struct(words.alias("w"), numbers.alias("n"), marks.alias("mark")), built)

    text = F.regexp_replace(F.lower(strip(c)), RX_TIME, "")
    return let(text, lambda t: F.when(t.rlike("^[^:]*[0-9][^:]*$"), read(t)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A date of digits as text; null if there is no such day. Two-digit years are 1969 to 2068."""
    full = F.when(F.length(year) > 2, year).otherwise((F.pmod(year.try_cast("int") - 69, F.lit(100)) + 1969).cast("string"))
    padded = F.concat(F.lpad(full, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when((F.length(full) <= 4) & (F.length(month) <= 2) & (F.length(day) <= 2), padded.try_cast("date"))


def open_end_year(c: ColumnOrName) -> Column:
    """Year of a range end, with the open end ``Incumbent`` read as the fixed year."""
    return let(strip(c), lambda t: F.when(t == OPEN_END_TEXT, F.lit(OPEN_END_YEAR)).otherwise(F.year(parse_date(t))))


def year_of_text(c: ColumnOrName) -> Column:
    """First run of four digits as an int (null when there is none)."""
    return F.nullif(F.regexp_extract(_col(c), r"[0-9]{4}", 0), F.lit("")).try_cast("int")


def panel_title(name: ColumnOrName, year: ColumnOrName) -> Column:
    """``name - year`` label."""
    return F.concat_ws(" - ", _col(name), _col(year).cast("string"))


def word_tokens(c: ColumnOrName) -> Column:
    """Lower-cased runs of letters, in text order (``ARRAY<STRING>``).

    The same tokens as splitting on ``RX_WORD`` and dropping empty pieces, taken in one pass.
    """
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(RX_LETTERS), F.lit(0))


def try_int(c: ColumnOrName) -> Column:
    """Cast to int, null on text that is not a number (ANSI ``cast`` would raise)."""
    return _col(c).try_cast("int")


def default_if_blank(c: ColumnOrName, default: str) -> Column:
    """H5: literal default for a null, empty or all-whitespace value."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def clean_strings(df: DataFrame, fn) -> DataFrame:
    """Apply ``fn`` (Column -> Column) to every string column, keep the others untouched."""
    return df.select(*[
        fn(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])
