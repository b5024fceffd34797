"""HTML tables stored inside pages -> rows.

Pages are cut at the tags of tables, rows and cells and exploded to one row per piece; one window sorts the pieces of each
page (without a shuffle if the pages are already dealt by their keys) and one pass over the sorted rows counts the depth of
their table tags. The n-th table of a page (in the order of open tags, nested ones counted) is the range from
its open tag to where the depth falls below its own; its rows and cells are the tags of that range at its own depth, so
a nested table is text of the cell that holds it. Open cells end at the next tag of a cell or row, whether closed
or not. Cells that span rows or columns fill every place of the grid that they cover. The pass holds one cell and one row
of a grid at a time, so memory grows neither with the corpus nor with the rows of a page.

The output is long (one row per place of the grid), which keeps any number of columns per page; ``table_to_columns``
pivots to named columns for a known header list.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tonekit.functions.html import decode_entities, strip_tags, tag_pieces
from tonekit.functions.text import strip
from tonekit.operators.generate import explode_rows

#: Widest span that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Places after which a batch is given on.
MOST_PLACES = 10_000

_PLACE_FIELDS = [StructField("row", IntegerType()), StructField("col", IntegerType()),
                 StructField("header", StringType()), StructField("value", StringType())]
_PLACE = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("header", pa.string()), ("value", pa.string())])


def _span(piece, name: str, most: int):
    text = F.regexp_extract(piece, rf"""(?is)^<[^>]*\s{name}\s*=\s*["']?\s*([0-9]{{1,5}})""", 1)
    return F.when(text == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), text.try_cast("int"))))


def _tags(df: DataFrame, html_col: str, keys: Sequence[str], table_tag: str, row_tag: str, cell_tags: Sequence[str]) -> DataFrame:
    """``(*keys, _n, _tag, _rowspan, _colspan, _piece)``: a page's pieces numbered from 1, in order within their partition.

    ``_tag``: 1 table, 2 row, 3 and more cell, less than 0 for a close tag, else 0.
    """
    tags = [table_tag, row_tag, *cell_tags]
    rows = explode_rows(df, tag_pieces(html_col, tags), ["_pos", "_piece"], list(keys), with_pos=True)
    kind = F.lower(F.regexp_extract("_piece", r"^\u0002?</?([A-Za-z][A-Za-z0-9]*)", 1))
    no = F.array_position(F.array(*[F.lit(t) for t in tags]), kind).cast("int")
    rows = rows.withColumn("_tag", F.when(F.col("_pos") == 0, 0).when(F.startswith("_piece", F.lit("\u0002")), -no).otherwise(no))
    spans = [F.when(F.col("_tag") > 2, _span(F.col("_piece"), name, most)).otherwise(1).alias(f"_{name}")
             for name, most in (("rowspan", MOST_ROWS), ("colspan", MOST_COLUMNS))]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_pos"))
    return rows.select(*keys, number.alias("_n"), "_tag", *spans, F.translate("_piece", "\u0002", "").alias("_piece"))


class _Grid:
    """The grid of one table, row by row as its cells come in; ``out`` takes ``(row, col, header, markup)``."""

    def __init__(self, out, header: bool):
        self.out, self.header = out, header
        self.row, self.col, self.here, self.head = 0, 0, {}, {}
        self.held: dict[int, tuple[int, str]] = {}  # column -> last row of a span, markup

    def add(self, row: int, rowspan: int, colspan: int, markup: str) -> None:
        while self.row < row:
            self.end_row()
            self.held = {c: h for c, h in self.held.items() if h[0] > self.row}
            self.row, self.col, self.here = self.row + 1, 0, {c: v for c, (_, v) in self.held.items()}
        while self.col in self.here:
            self.col += 1
        for k in range(self.col, self.col + colspan):
            self.here.setdefault(k, markup)
            if rowspan > 1:
                self.held[k] = (row + rowspan - 1, markup)
        self.col += colspan

    def end_row(self) -> None:
        """Spans over rows reach to the last row with a cell: a row is complete when a later one has a cell, or at the end."""
        if self.header and self.row == 0:
            self.head = self.here
            return
        for c, v in sorted(self.here.items()):
            self.out(self.row, c, self.head.get(c), v)


def _places(n_keys: int, nth: int, header: bool):
    """Pieces of whole pages, in order, to places of the nth table's grid; holds one open cell and one row of the grid."""
    def run(batches):
        places, last, schema = [], None, None
        at, grid = 0, None
        depth = tables = own = row = rowspan = colspan = 0
        cell: list[str] | None = None
        ended = True

        def out(*place):
            places.append((at, *place))

        def end_cell():
            nonlocal cell
            if cell is not None and row >= 0:
                grid.add(row, rowspan, colspan, "".join(cell))
            cell = None

        def end_table():
            if not ended:
                end_cell()
                grid.end_row()

        def made():
            at_, *columns = zip(*places) if places else ((), (), (), (), ())
            rows = [k.take(pa.array(at_, pa.int64())) for k in known]
            return pa.RecordBatch.from_arrays([*rows, *(pa.array(c, t) for c, t in zip(columns, _PLACE.types))], schema=schema)

        for batch in batches:
            keys = batch.columns[:n_keys]
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(n_keys)], *_PLACE])
            # the key of a place is that of the row before the one that ends it
            known = [pa.concat_arrays([b, k]) for b, k in zip(last or [k.slice(0, 1) for k in keys], keys)]
            for at, (n, tag, down, across, piece) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n_keys:]))):
                if n == 1:
                    end_table()
                    depth, tables, own, ended, cell = 0, 0, None, False, None
                    row, grid = -1, _Grid(out, header)
                if tag == 1:
                    depth, tables = depth + 1, tables + 1
                elif tag == -1:
                    depth -= 1
                if own is None:
                    if tag == 1 and tables == nth + 1:
                        own = depth
                elif not ended:
                    if depth < own:
                        end_table()
                        ended = True
                    elif depth == own and abs(tag) > 1:
                        end_cell()
                        if tag == 2:
                            row += 1
                        elif tag > 2:
                            cell, rowspan, colspan = [piece], down, across
                    elif cell is not None:
                        cell.append(piece)
                if len(places) >= MOST_PLACES:
                    yield made()
                    places.clear()
            last = [k.slice(len(k) - 1) for k in keys] if batch.num_rows else last
            at = 0
            yield made()
            places.clear()
        if last:
            known = last
            end_table()
            yield made()

    return run


def html_table(df: DataFrame, html_col: str, nth: int = 0, keys: Sequence[str] = ("page_id",), table_tag: str = "table",
               row_tag: str = "tr", cell_tags: Sequence[str] = ("th", "td"), header: bool = True) -> DataFrame:
    """``(*keys, row, col, header, value)`` of the n-th table (0-based): its data rows (row >= 1) with the first row as
    header, or with ``header=False`` (lists) all rows and a null header."""
    pieces = _tags(df, html_col, keys, table_tag, row_tag, cell_tags)
    kept = StructType([*[pieces.schema[k] for k in keys], *_PLACE_FIELDS])
    places = pieces.mapInArrow(_places(len(keys), nth, header), kept)

    def text(markup: str):
        return strip(decode_entities(strip_tags(markup)))

    return places.select(*keys, "row", "col", text("header").alias("header"), text("value").alias("value"))


def table_to_columns(long_df: DataFrame, keys: Sequence[str], headers: Sequence[str]) -> DataFrame:
    """Pivot the long table to one column per header (explicit header list, no discovery job)."""
    return (long_df.groupBy(*keys, "row").pivot("header", list(headers)).agg(F.first("value")))
