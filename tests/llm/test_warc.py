import base64
import hashlib
from collections import defaultdict

from tonekit.llm import warc
from tonekit.llm.warc import op10_warc, read_warc, write_warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    first = defaultdict(list)
    for i, _, html in rows:
        first[html or ""].append(i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [x for x in first[html or ""] if x is not None]
        low = min(ids) if ids else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if i == low else "revisit", None if i == low else low))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op10(spark, sf_dir, rows):
    assert got(op10_warc(spark, sf_dir)) == expected(rows("pages", "page_id, url, html"))


FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")


def test_records_inside_payloads(spark, put, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 40)
    pages = [(i, f"http://x/{i}", f"<p>{i % 7}</p>{FAKE * (i % 3)}WARC/1.1\r\n{'é' * i}\r\n\r\n") for i in range(300)]
    pages += [(1000 + i, None, FAKE) for i in range(30)] + [(2000, "a b\r\nX-Page-Id: 5", "\r\n\r\n"), (2001, "", "x\x00y" * 50_000)]
    assert got(op10_warc(spark, put("pages", pages, PAGES))) == expected(pages)


def test_odd_rows(spark, put):
    pages = [(1, "u", None), (2, "u", ""), (3, None, " "), (4, "u", " "), (None, "u", " "), (None, "v", "only"), (-6, "u", "only two")]
    assert got(op10_warc(spark, put("pages", pages, PAGES))) == expected(pages)
    pages = [(5, "u", "same"), (5, "u", "same"), (6, "u", "same")]
    assert got(op10_warc(spark, put("pages", pages, PAGES))) == expected(pages)
    assert op10_warc(spark, put("pages", [], PAGES)).collect() == []


def test_files_are_warc(spark, put, tmp_path):
    """The written bytes are a plain chain of records, read here without the operator."""
    pages = [(i, f"http://x/{i}", "<p>" * (i % 5)) for i in range(50)]
    folder = f"{tmp_path}/out"
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    n = 0
    for file in (tmp_path / "out").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1" and any(x.startswith("WARC-Record-ID: <urn:") for x in lines)
            size = int(next(x for x in lines if x.startswith("Content-Length: "))[16:])
            at += len(head) + 4 + size
            assert data[at: at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
    assert n == 50 == read_warc(spark, folder).count()


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    pages = [(i, f"http://x/{i}", f"{i} " + "p" * (90_000 if i == 7 else 2_000)) for i in range(60)]
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame(pages, PAGES).coalesce(1), folder)
    files = spark.read.format("binaryFile").load(folder).select("length").collect()
    assert len(files) >= 20 and max(f["length"] for f in files) <= 300_000
    assert got(read_warc(spark, folder)) == expected(pages)
