"""HTML field expressions over a page's markup string (H2-H5).

Elements are balanced. A page is split once at the open and close tags of the wanted name (comments, scripts and
styles are taken out first), one fold over the pieces finds the first element with the class and counts depth
(open +1, close -1) to its own close tag, and the pieces between are its markup; an element that is never closed
reaches to the end of the page. Then inner tags are removed and the common character entities are decoded.
All of it are column expressions, linear in the page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonekit.functions.text import let, rstrip, strip

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Names of the standard's table (from the standard library), some of them also without the closing semicolon.
_NAMED = {name: char for name, char in html5.items()}
#: The most frequent ones, looked for before the table is.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;")
_LEGACY = "|".join(sorted((n for n in _NAMED if not n.endswith(";")), key=lambda n: (-len(n), n)))
RX_REFERENCE = rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9A-Fa-f]{{1,6}};?|[A-Za-z][A-Za-z0-9]{{0,31}};|(?:{_LEGACY}))"


def _character(ref: Column) -> Column:
    """The character of one reference; names that are not known stay as they are."""
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string, string>")
    digits = F.regexp_extract(ref, "#[xX]?([0-9A-Fa-f]+)", 1)
    code = F.conv(digits, 10, 16)
    code = F.when(ref.rlike("^&#[xX]"), digits).otherwise(code)
    valid = F.conv(code, 16, 10).cast("int").between(1, 0x10FFFF) & ~F.conv(code, 16, 10).cast("int").between(0xD800, 0xDFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    found = F.when(F.startswith(ref, F.lit("&#")), char)
    for name in _COMMON:
        found = found.when(ref == F.lit(f"&{name}"), F.lit(_NAMED[name]))
    return found.otherwise(F.coalesce(F.try_element_at(names, F.substring(ref, 2, 40)), ref))


def decode_entities(c: ColumnOrName) -> Column:
    """Decode character references, named and numeric, in one pass; texts without ``&`` pass at once."""
    def decoded(text: Column) -> Column:
        between = F.split(text, RX_REFERENCE, -1)
        refs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(RX_REFERENCE), F.lit(0)), _character), F.array(F.lit("")))
        return F.array_join(F.zip_with(between, refs, lambda t, r: F.concat(t, r)), "")
    return let(_col(c), lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def strip_tags(c: ColumnOrName) -> Column:
    """Remove markup, keep text."""
    return F.regexp_replace(_col(c), r"<[^>]*>", "")


# Comments, and elements whose content is no markup.
RX_ASIDE = r"(?is)<(?:!--.*?-->|(script|style)(?:\s[^>]*)?>.*?</\1\s*>)"
# Inside an open tag: quoted values may hold ">".
_ATTRIBUTES = r"""(?:\s(?:[^>"']++|"[^"]*"|'[^']*')*+)?"""
_CUT, _CLOSE = "\u0001", "\u0002"


def plain_markup(html: ColumnOrName) -> Column:
    """A page without comments, scripts and styles (and without the two characters that mark cuts)."""
    return F.regexp_replace(_without(_without(_col(html), _CUT), _CLOSE), RX_ASIDE, "")


def _without(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def tag_pieces(html: ColumnOrName, tags: Sequence[str], plain: bool = False) -> Column:
    """A page cut before every open and close tag of ``tags``; close tags are marked with U+0002.

    ``plain``: the page has been through ``plain_markup`` already.
    """
    names = "|".join(re.escape(t) for t in tags)
    opened = F.regexp_replace(_col(html) if plain else plain_markup(html), rf"(?is)<(?:{names}){_ATTRIBUTES}/?>", _CUT + "$0")
    return F.split(F.regexp_replace(opened, rf"(?is)</(?:{names})\s*>", _CUT + _CLOSE + "$0"), _CUT)


def open_tag(tag: str, css_class: str | None = None) -> str:
    """Regex of an open tag at the start of a piece, with ``css_class`` among its classes."""
    if css_class is None:
        return rf"(?is)^<{re.escape(tag)}{_ATTRIBUTES}/?>"
    cls = re.escape(css_class)
    return rf"""(?is)^<{re.escape(tag)}(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\sclass\s*=\s*(?:["'](?:[^"'>]*\s)?{cls}(?:\s[^"'>]*)?["']|{cls}(?=[\s>]))"""


def element_markup(html: ColumnOrName, tag: str, css_class: str | None = None, plain: bool = False) -> Column:
    """Markup inside the first balanced element with ``tag`` (and ``css_class``); null without one."""
    def inner(pieces: Column) -> Column:
        none = F.lit(-1)
        state = F.struct(F.lit(0).alias("at"), none.alias("start"), F.lit(0).alias("depth"), none.alias("stop"))

        def step(acc: Column, piece: Column) -> Column:
            close = F.startswith(piece, F.lit(_CLOSE))
            begins = (acc["start"] < 0) & ~close & piece.rlike(open_tag(tag, css_class))
            inside = (acc["start"] >= 0) & (acc["stop"] < 0)
            depth = F.when(begins, 1).when(inside & close, acc["depth"] - 1).when(inside, acc["depth"] + 1).otherwise(acc["depth"])
            return F.struct((acc["at"] + 1).alias("at"), F.when(begins, acc["at"]).otherwise(acc["start"]).alias("start"),
                            depth.alias("depth"),
                            F.when(inside & close & (acc["depth"] == 1), acc["at"]).otherwise(acc["stop"]).alias("stop"))

        def cut(found: Column) -> Column:
            stop = F.when(found["stop"] < 0, found["at"]).otherwise(found["stop"])
            body = F.array_join(F.slice(pieces, found["start"] + 1, stop - found["start"]), "")
            body = F.regexp_replace(_without(body, _CLOSE), open_tag(tag), "")
            return F.when(found["start"] >= 0, body)

        return let(F.aggregate(pieces, state, step), cut)

    found = let(tag_pieces(html, [tag], plain), inner)
    # only pages with the class, or the beginning of such a tag, are cut
    named = F.contains(_col(html), F.lit(css_class)) if css_class is not None else F.contains(F.lower(_col(html)), F.lit(f"<{tag.lower()}"))
    return F.when(named, found)


def element_text(html: ColumnOrName, tag: str, css_class: str | None = None, plain: bool = False) -> Column:
    """H3: text of the first element with ``tag`` (and ``css_class``), right-stripped; null without one."""
    return rstrip(decode_entities(strip_tags(element_markup(html, tag, css_class, plain))))


def first_match(html: ColumnOrName, selectors: Sequence[tuple[str, str | None]], plain: bool = False) -> Column:
    """H4: text of the first selector that finds a non-empty element, else null."""
    def filled(text: Column) -> Column:
        return let(text, lambda t: F.when(t != F.lit(""), t))
    return F.coalesce(*[filled(strip(element_text(html, tag, cls, plain))) for tag, cls in selectors])


def absolutize(c: ColumnOrName, base: str | Column) -> Column:
    """H2: prefix a relative link with ``base`` (a literal or a per-row column); absolute links are kept."""
    link = _col(c)
    prefix = F.lit(base) if isinstance(base, str) else base
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).otherwise(F.concat(prefix, link))


#: An ``href`` value of an ``<a>`` element: in quotes of either kind, or bare.
RX_HREF = r"""(?i)<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def link_targets(html: ColumnOrName) -> Column:
    """All ``href`` values of ``<a>`` elements in document order (``ARRAY<STRING>``), entities decoded."""
    return F.transform(F.regexp_extract_all(_col(html), F.lit(RX_HREF), F.lit(1)),
                       lambda h: decode_entities(F.regexp_replace(h, """^["']|["']$""", "")))
