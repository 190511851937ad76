"""Operator 2: archives written and read back."""

import gzip
import hashlib

from tabstat.llm import warc

BIG = "x" * 1500 + "é"
PAGES = [
    (1, "http://a.example.com/x", BIG), (2, "http://b.example.com/y?q=1#f", BIG), (3, None, BIG), (4, "http://a.example.com/x", "short"),
    (5, "http://a.example.com/x", "short"), (6, "http://ü.de/a b\r\nc", None), (None, "http://n", BIG), (7, "::bad[", ""), (2, "http://b.example.com/y?q=1#f", BIG),
    (3, None, BIG), (8, "http://h", "WARC/1.1\r\n\r\n\0\n" + "y" * 900), (9, "http://h:81/", "z" * 1000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS key", "3 AS file")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect())
    want = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        last = max((p for p, _, h in PAGES if h == html and p is not None), default=None)
        again = len(payload) >= 1000 and page is not None and page < last
        want.append((page or 0, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=lambda r: r[:4])


def test_archives_are_plain_gzip(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    folder = warc.write_archives(pages).replace("file:", "")
    import glob

    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(folder + "/part-*"))
    assert text.count(b"WARC/1.1\r\n") == 4
    assert text.count(BIG.encode()) == 1


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_member_ends_in_zero():
    payload = b"q" * ((1 << 24) + 5)
    data = warc.member(1, "http://h/", payload, "d", None)
    assert data[-1] == 0
    found = list(warc.members(data + warc.member(2, None, b"", "e", None)))
    assert [len(f) for f in found] == [3, 3] and warc.read_record(found[0][2])[1].endswith(b"q")
    assert data[found[0][0]:found[0][0] + found[0][1]] == data


def test_key_order():
    keys = [warc.capture_key(u, 1) for u in ("http://b.a.com/", "http://a.com/z", "http://c.a.com/")]
    assert keys == ["com,a,b)/ 1", "com,a)/z 1", "com,a,c)/ 1"]
