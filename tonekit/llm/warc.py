"""Operator 10: WARC archives of pages, written and read back by boundary chains.

Writing. Payloads are compared by SHA-1: of the records with one payload the smallest page id
is a ``response``, the others are ``revisit`` records that name it. Spark's text writer
writes them: a row is a record, the line separator is the blank line after a record, so the part
files are WARC 1.1 files, and a retried task leaves no half file.

Reading. A payload may hold anything, also what looks like a record. A task that reads a file emits
for *every* place with the magic the offset at which the record there would end (header and
content length): candidate and successor. True records are those that a chain from the file's start
reaches. Pointer jumping finds them: with each round the reached set follows the successors'
successors, so a chain of n records takes about log2(n) rounds, each a join of offsets only.
Magic inside a payload has no such chain and is dropped. Files hold at most ``RECORDS`` records and
``FILE_BYTES`` bytes (or one record), so a file is what a task can read, and rounds are few. Offsets are joined by
shuffles on (file, offset): their tables grow with the archives and are never broadcast.

Defined results: a null html is an empty payload; a null page id is kept as such and never the
response of others unless all ids of a payload are null; rows with the same smallest id and payload
are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import scratch, staged, table

#: Records of a file at most. Characters of a target URI that would end its header line.
RECORDS, FILE_BYTES, HEADER_BYTES = 2_000, 256 << 20, 4_096
_CONTROL = r"[\x00-\x20\x7F]"
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Payloads with copies up to which their table (some 60 bytes a row) is broadcast.
FEW_PAYLOADS = 100_000
#: Date of the records: fixed, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
_FOUND = "file string, at long, next long, " + _RECORD


def _line(name: str, value: Column) -> Column:
    """A header line; no line for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``record``: the text of each record without the blank line after it."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # payloads that occur again, of any page: a row per payload and task, then per payload
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("n > 1").select("sha1", "first_id", F.lit(True).alias("again")), "again")
    if first.count() <= FEW_PAYLOADS:  # else a shuffle join, in which Spark splits a hot payload
        first = F.broadcast(first)
    rows = rows.join(first, "sha1", "left")
    same = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    size = F.octet_length("html")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(same, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:tonekit:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", _CONTROL, "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32("sha1"))),
        _line("WARC-Profile", F.when(~same, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(~same, F.concat(F.lit("<urn:tonekit:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Payload-Length", size),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(same, size).otherwise(F.lit(0))),
        F.lit("\r\n"))
    return rows.select(F.concat(head, F.when(same, F.col("html")).otherwise(F.lit(""))).alias("record"))


def _base32(hex_col: str) -> Column:
    """Base 32 of 40 hex digits: 5 bits a character, made from the digits' binary text."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_col, 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])
    return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                                  F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)])


def write_warc(pages: DataFrame, folder: str, **columns: str) -> None:
    """Write the records of ``pages`` as WARC files below ``folder``."""
    html, url = columns.get("html_col", "html"), columns.get("url_col", "url")
    size = F.coalesce(F.octet_length(html), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length(url), F.lit(0)) + HEADER_BYTES
    largest = pages.agg(F.max(size)).first()[0] or HEADER_BYTES
    limit = max(1, min(RECORDS, FILE_BYTES // largest))
    records(pages, **columns).write.option("lineSep", END.decode()).option("maxRecordsPerFile", limit).text(folder)


_MAGIC = re.compile(re.escape(MAGIC))
_URN = re.compile(r"<urn:tonekit:page:(-?\d+)>")


def _candidates(batches):
    """Every place with the magic: what the record there would say and where it would end."""
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, rows = content.as_buffer(), []
            view = memoryview(data)
            for m in _MAGIC.finditer(view):
                end = _find(view, m.end())
                if end < 0:
                    continue
                head = dict(x.split(": ", 1) for x in bytes(view[m.end(): end]).decode("utf-8", "replace").split("\r\n")
                            if ": " in x)
                if not (size := head.get("Content-Length", "")).isdecimal():
                    continue
                body = end + len(END)
                stop = body + int(size)
                if stop + len(END) > len(view) or bytes(view[stop: stop + len(END)]) != END:
                    continue  # nothing that could be a whole record
                rows.append((file, m.start(), stop + len(END), *_said(head, view[body: stop])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split(" ")[1]] for c in _FOUND.split(", ")]


def _find(view: memoryview, at: int, step: int = 4096) -> int:
    """Offset of the blank line that ends a header, looked for piece by piece."""
    while at < len(view):
        k = bytes(view[at: at + step]).find(END)
        if k >= 0:
            return at + k
        if at + step >= len(view):
            return -1
        at += step - len(END) + 1
    return -1


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _said(head: dict[str, str], payload: memoryview) -> tuple:
    """Page id, payload size, digest, type and the response named by a record.

    A response's size and digest come from its payload; a revisit has none, its header tells.
    """
    kind = head.get("WARC-Type", "")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size, digest = _number(head.get("X-Payload-Length")), head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    named = _URN.fullmatch(head.get("WARC-Refers-To", ""))
    return _number(head.get("X-Page-Id")), size, digest, kind, int(named[1]) if named else None


def reachable(found: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that a chain from offset 0 of their file reaches.

    After round k the set holds the first 2 ** k records of each file, and the pointers lead
    2 ** k records on. Each round is a table in the shared folder, so plans stay short.
    """
    jump = found.select("file", "at", "next")
    ends = found.select("file", F.col("at").alias("to")).hint("merge")
    jump = staged(jump.join(ends, (jump["file"] == ends["file"]) & (jump["next"] == ends["to"]), "left_semi"), "jump0")
    reached = staged(found.where("at = 0").select("file", "at"), "reached0")
    n, k = reached.count(), 0
    while True:
        k += 1
        new = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
        reached_now = staged(reached.union(new), f"reached{k}")
        now = reached_now.count()
        if now == n:
            return reached
        reached, n = reached_now, now
        on = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = staged(jump.join(on.hint("merge"), ["file", "next"]).select("file", "at", F.col("then").alias("next")), f"jump{k}")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The true records of all WARC files below ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = staged(files.mapInArrow(_candidates, _FOUND), "candidates")
    return found.join(reachable(found).hint("merge"), ["file", "at"]).select(*[c.split(" ")[0] for c in _RECORD.split(", ")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder)


#: The same from the pages alone: what the archives must say.
_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
        '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits,
        min(page_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS n FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        16 * CAST(substr(bits, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INTEGER)
        + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * k + 5, 1) AS INTEGER), 1)), '') AS digest,
        n = 1 OR page_id IS NOT DISTINCT FROM first_id AS own FROM b)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT own THEN first_id END AS refers_to FROM d"""

QUERIES = {"op10_warc": op10_warc}
ORACLES: dict[str, str] = {"op10_warc": _SQL}
