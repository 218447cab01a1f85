import gzip
import hashlib
import io
import random

import pytest

from tallywake.llm import warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
CLASHING = ["digest", "size", "path", "type", "payload", "uri", "main", "x.y"]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def plain(rows, least=1000):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for page, body in payloads:
        same = [p for p, b in payloads if b == body and p is not None]
        largest = max(same, default=None) if len(body) >= least else None
        again = largest is not None and page != largest
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", largest if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


BIG = "<p>" + "é漢😂 " * 400
EMBEDDED = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 30


def test_awkward_pages(spark):
    rows = [
        (1, "http://a.example/x?y=1", BIG), (2, "http://b.example", BIG), (9, None, BIG), (None, "http://n.example/", BIG), (None, None, BIG),
        (3, "http://c.example/\r\nEvil: 1", "short"), (4, "not a url at all ", "short"), (5, "", None), (6, "http://d.example/", ""),
        (7, "http://e.example/", EMBEDDED), (8, "http://é.example/漢?q=ä#f", EMBEDDED), (10, "http://f.example/", "x" * 3_000_000),
        (11, "u", "r" * 999), (12, "u", "r" * 999), (13, "u", "r" * 1000), (14, "u", "r" * 1000), (14, "u", "r" * 1000), (15, "u", "\r\n\r\n" * 500), (15, "u", "\r\n\r\n" * 500),
        (None, "u", "only without ids " * 99), (None, "v", "only without ids " * 99), (-5, "u", "negative " * 200), (-7, "u", "negative " * 200),
        (16, "u", "line one\r\n\r\nline \x00 two\n"), (17, "u", "page-id: 99\r\n"),
    ]
    df = warc.round_trip(table(spark, rows).repartition(4))
    assert got(df) == plain(rows)
    assert all(r.intact for r in df.select("intact").collect())


def test_many_copies(spark):
    r = random.Random(4)
    rows = [(i, f"http://h{i % 7}.example/{i}", f"body {r.choice('abc')} " * (200 if i % 3 else 20)) for i in range(400)]
    assert got(warc.round_trip(table(spark, rows))) == plain(rows)
    assert got(warc.round_trip(table(spark, rows), least=1)) == plain(rows, 1)


def test_empty_table(spark):
    assert got(warc.round_trip(table(spark, []))) == []


def test_nested_rows_and_listing(spark, tmp_path):
    rows = [(1, "http://a.example/x", BIG), (2, "http://b.example/y", BIG), (3, "http://c.example/", "tiny")]
    written = warc.write_archive(table(spark, rows), str(tmp_path / "out"))
    assert written.count() == 3
    nested = {r.page_id: r for r in warc.read_archive(warc.archives(spark, str(tmp_path / "out"))).collect()}
    assert bytes(nested[2].main.payload).decode() == BIG and nested[2].refers_to is None
    assert nested[1].main.type == "revisit" and nested[1].refers_to == 2 and bytes(nested[1].main.payload) == b""
    assert nested[1].main.refers_to == nested[2].capture_id
    assert nested[3].request.http_head.startswith("GET / HTTP/1.1\r\nHost: c.example\r\n")
    assert nested[3].main.uri == "http://c.example/" and "page-id: 3" in bytes(nested[3].metadata.payload).decode()
    # Every record is a gzip member of its own: another reader finds the same bytes.
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type:") == 9 + len(list((tmp_path / "out").glob("*.warc.gz")))


def test_small_files_and_uncompressed(spark, tmp_path, monkeypatch):
    record = warc._record("response", "urn:x:1", "http://a/", warc.NO_DATE, "text/plain", b"body", [])
    request = warc._record("request", "urn:x:2", "http://a/", warc.NO_DATE, "text/plain", b"ask", [("WARC-Concurrent-To", "<urn:x:1>")])
    orphan = warc._record("metadata", "urn:x:3", "http://a/", warc.NO_DATE, "text/plain", b"lost", [("WARC-Concurrent-To", "<urn:x:9>")])
    other = warc._record("warcinfo", "urn:x:4", None, warc.NO_DATE, "text/plain", b"", [])
    (tmp_path / "one.warc").write_bytes(other + request + record)
    (tmp_path / "two.WARC.gz").write_bytes(gzip.compress(orphan))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "skip.txt").write_bytes(b"no archive")
    rows = {r.capture_id: r for r in warc.transactions(warc.read_records(warc.archives(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"urn:x:1", "urn:x:9"}
    assert bytes(rows["urn:x:1"].main.payload) == b"body" and bytes(rows["urn:x:1"].request.payload) == b"ask" and rows["urn:x:1"].metadata is None
    assert rows["urn:x:9"].main is None and bytes(rows["urn:x:9"].metadata.payload) == b"lost"


@pytest.mark.parametrize("harm", [lambda b: b[:-6], lambda b: b[:30], lambda b: b"junk\r\n" + b])
def test_damaged_archives_are_errors(harm):
    record = warc._record("response", "urn:x:1", "http://a/", warc.NO_DATE, "text/plain", b"body", [])
    with pytest.raises(ValueError, match="name.warc"):
        list(warc.records(io.BytesIO(harm(record)), "name.warc"))


def test_continued_headers():
    raw = b"WARC/1.0\r\nWARC-Type: metadata\r\nX: one\r\n two\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(r.first("x"), r.block) for r in warc.records(io.BytesIO(raw))] == [("one two", b"hi")]
