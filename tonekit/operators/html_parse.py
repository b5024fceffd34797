"""Element text with a real HTML parser, for pages the regex extraction cannot handle (H3/H4 variant).

``functions.html`` cuts the first element out with a lazy regex, which is exact for flat markup
but ends a nested element (``<div><div>..</div>..</div>``) at the inner close tag and decodes only
a fixed entity table. This variant runs the standard library ``html.parser`` on each page inside
``mapInPandas`` (Arrow batches; Spark partitions and schedules the pages): it tracks nesting depth,
decodes every character reference, and ignores tags inside ``<script>``/``<style>`` text. It is the
slow path (Python per page), meant for the pages that need it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# The per-page parser runs in Python workers. Ship this module's code with the task (pickle by
# value) so executors need no installed copy of the package; it depends on the standard library
# and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _FirstElementText(HTMLParser):
    """Collects the text of the first element with ``tag`` (and ``css_class``), nesting-aware."""

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag, css_class
        self.depth = 0
        self.found = False
        self.done = False
        self.parts: list[str] = []

    def _matches(self, tag: str, attrs) -> bool:
        if tag != self.tag:
            return False
        if self.css_class is None:
            return True
        classes = (dict(attrs).get("class") or "").split()
        return self.css_class in classes

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if self.depth:
            if tag == self.tag:
                self.depth += 1
        elif self._matches(tag, attrs):
            self.found = True
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1
            if self.depth == 0:
                self.done = True

    def handle_data(self, data):
        if self.depth and not self.done:
            self.parts.append(data)


def element_text_py(html: str | None, tag: str, css_class: str | None = None) -> str | None:
    """Text of the first matching element (right-stripped), None when there is none."""
    if html is None:
        return None
    p = _FirstElementText(tag, css_class)
    p.feed(html)
    p.close()
    return "".join(p.parts).rstrip() if p.found else None


def first_match_py(html: str | None, selectors: Sequence[tuple[str, str | None]]) -> str | None:
    """First selector whose element has non-blank text (stripped), else None."""
    for tag, cls in selectors:
        text = element_text_py(html, tag, cls)
        if text is not None and text.strip():
            return text.strip()
    return None


def parse_fields(df: DataFrame, html_col: str, keys: Sequence[str],
                 fields: dict[str, Sequence[tuple[str, str | None]]]) -> DataFrame:
    """``(*keys, <field>...)``: for each field the first non-blank element among its selectors."""
    key_fields = [df.schema[k] for k in keys]
    schema = StructType(key_fields + [StructField(name, StringType()) for name in fields])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            for name, selectors in fields.items():
                out[name] = [first_match_py(h, selectors) for h in pdf[html_col]]
            yield out

    return df.select(*keys, html_col).mapInPandas(run, schema)
