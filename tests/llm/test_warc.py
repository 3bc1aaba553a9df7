"""Archives: an exact round trip, repeated payloads, foreign records, and every odd case of a page table."""

import gzip
import hashlib
import uuid

import pytest

from jobscope.llm import warc
from jobscope.llm.common import shared_dir, stored

SCHEMA = "page_id long, url string, html string, payload_digest string, record_type int, response string"


def odd_pages():
    long = "<p>é " + "x" * 300_000 + "</p>"
    tricky = "<pre>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 WARC/1.</pre>" + "y" * 90
    copy = "<p>" + "copy " * 40 + "</p>"
    small = "<p>small</p>"
    rows = [(i, f"http://h{i % 3}.example/p/{i}?q=1", f"<p>page {i} " + "w" * (40 + 10 * i) + "</p>") for i in range(20)]
    rows += [(30 + i, f"http://copies.example/{i}", copy) for i in range(25)]
    rows += [(60, "http://a.example/", small), (61, "http://a.example/", small), (62, None, None), (63, "", ""), (None, "http://n.example/", copy), (None, None, None)]
    rows += [(64, "http://a.example/with blank\r\nX-Header: 1", long), (65, "not a url\t", long), (66, "//h/x", tricky), (67, "//h/x", tricky + "\r\n\r\n")]
    rows += [(5, "http://h2.example/p/5?q=1", rows[5][2]), (30, "http://copies.example/0", copy), (-4, "http://neg.example", "日本語 " * 60), (70, "x", "日本語 " * 60)]
    rows += [(None, "http://m.example/1", "<i>only pages without id</i>" * 9), (None, "http://m.example/2", "<i>only pages without id</i>" * 9)]
    return rows


def expected(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and (html in first) and key != first[html]
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark):
    rows = odd_pages()
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame([(*r, "d", 1, "r") for r in rows], SCHEMA).repartition(3), path)
    return rows, path


def test_pages_come_back(spark, archive):
    rows, path = archive
    for payloads in (True, False):
        got = warc.page_rows(warc.records(spark, path, payloads)).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)


def test_captures_hold_all_three_records_and_the_payload(spark, archive):
    rows, path = archive
    got = warc.captures(stored(warc.records(spark, path), "r")).collect()
    assert len(got) == len(rows)
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in got)
    kept = sorted(bytes(r.response.payload) for r in got if r.response.record_type == "response")
    want = [(html or "").encode() for (_, _, html), e in zip(sorted(rows, key=lambda r: repr((r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()))), expected(rows), strict=True) if e[3] == "response"]
    assert kept == sorted(want)
    assert all(bytes(r.response.payload) == b"" for r in got if r.response.record_type == "revisit")
    assert {r.response.http_status for r in got} == {200}
    for r in got:
        assert "\r" not in (r.response.target_uri or "") and " " not in (r.response.target_uri or "")


def test_the_files_are_plain_archives(spark, archive):
    rows, path = archive
    files = [r[0] for r in spark.read.format("binaryFile").load(path + "/*.gz").select("content").collect()]
    text = b"".join(gzip.decompress(bytes(f)) for f in files)
    n = at = 0
    while at < len(text):  # read by Content-Length alone
        end = text.index(b"\r\n\r\n", at)
        head = text[at:end]
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert text[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
        n += 1
    assert n == 3 * len(rows)


def record(kind, rid, body, *more, version="1.0"):
    raw = body.encode()
    head = [f"WARC/{version}", f"WARC-Type: {kind}", *([f"warc-record-id: {rid}"] if rid else []), *more, f"Content-Length: {len(raw)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + raw + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Links in either direction and over another record, several members, records of their own, one member a record."""
    http = "HTTP/1.1 404 Not Found\r\ncontent-length: 3\r\n\r\nabc"
    there = [
        record("warcinfo", "<i>", "software: x"),
        record("request", "<q1>", "GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        record("response", "<r1>", http, "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>", "Content-Type: application/http; msgtype=response"),
        record("metadata", "<m1>", "via: x", "Content-Type: application/warc-fields"),
        record("metadata", "<m2>", "about the request", "WARC-Concurrent-To: <q1>"),
        record("resource", "<r2>", "plain WARC/1.0 text", "Content-Type: text/plain", version="1.1"),
        record("metadata", "<m3>", "alone", "WARC-Concurrent-To: <nowhere>"),
        record("conversion", "<c1>", "", "WARC-Concurrent-To: <r2>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in there[:5]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(there[5:])))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    found = warc.records(spark, str(tmp_path))
    assert found.count() == 8
    got = {r.capture: r for r in warc.captures(found).collect()}
    assert set(got) == {"<r1>", "<r2>", "<m3>"}
    assert [x.record_id for x in got["<r1>"].requests] == ["<q1>"] and [x.record_id for x in got["<r1>"].metadata] == ["<m1>", "<m2>"]
    assert got["<r1>"].response.http_status == 404 and bytes(got["<r1>"].response.payload) == b"abc"
    assert bytes(got["<r2>"].response.payload) == b"plain WARC/1.0 text" and [x.record_id for x in got["<r2>"].metadata] == ["<c1>"]
    assert got["<m3>"].response is None and got["<m3>"].metadata[0].record_id == "<m3>"


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("resource", "<r>", "abcdef")[:-8]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.records(spark, str(tmp_path)).collect()


def test_an_empty_table(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.page_rows(warc.records(spark, path)).count() == 0
