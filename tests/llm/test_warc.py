import io
import zipfile
import zlib

import pytest

from tessera.llm.common import Scratch
from tessera.llm.warc import archive_round_trip, parse_record, payload_digest, read_packages, record, write_packages
from tessera.llm.zip_archive import ZipReader, ZipWriter


def test_own_packages_are_plain_zip_files():
    out = io.BytesIO()
    package = ZipWriter(out)
    package.member("a/é.txt", [b"one ", b"two"])
    package.member("empty", [])
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.read("a/é.txt") == b"one two" and z.read("empty") == b"" and z.testzip() is None
    own = ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert own.read("a/é.txt", 2, 3) == b"e t"
    with pytest.raises(ValueError):
        own.read("a/é.txt", 5, 9)


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 inside", b"x" * 60_000])
def test_foreign_packages(comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("m.warc", b"0123456789" * 50)
        z.writestr("packed", b"aaaa" * 99, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"wide bytes")
        z.comment = comment
    reader = ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert reader.read("m.warc", 10, 5) == b"01234" and reader.read("wide") == b"wide bytes"
    with pytest.raises(ValueError):
        reader.read("packed")
    with pytest.raises(ValueError):
        ZipReader(io.BytesIO(out.getvalue()[:-30]), len(out.getvalue()) - 30)


def test_record_round_trip():
    body = "é\r\n\r\nx".encode()
    found = parse_record(record(7, "http://a/\r\nX: y", body))
    assert found["payload"] == body and found["page_id"] == 7 and found["record_type"] == "response"
    found = parse_record(record(None, None, body, refers_to=9))
    assert found["payload"] is None and found["refers_to"] == 9 and found["payload_bytes"] == len(body) and found["page_id"] is None
    broken = record(7, "u", body).replace(b"x\r\n\r\n", b"y\r\n\r\n")
    with pytest.raises(ValueError):
        parse_record(broken)


def test_table(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", "own"), (None, "http://e", "same"), (2, "http://f", "same"), (6, "http://g", "big " * 90_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, refers_to int, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_round_trip(pages).collect()), key=repr)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        want.append((page, len(body), payload_digest(body), "response" if page == top else "revisit", None if page == top else top))
    assert got == sorted(want, key=repr)
    assert archive_round_trip(pages.limit(0)).count() == 0
    small = [r.record_type for r in archive_round_trip(pages, least=5).collect()]
    assert small.count("revisit") == 0


def test_payloads_come_back(spark):
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([(i, "u", f"<p>{i} été</p>") for i in range(300)], "page_id long, url string, html string")
    packages = scratch.keep(write_packages(pages, scratch.path("p"), scratch), "list").collect()
    assert sum(p.n_records for p in packages) == 300
    assert {r.page_id: bytes(r.payload).decode() for r in read_packages(spark, packages, True).collect()} == {i: f"<p>{i} été</p>" for i in range(300)}
    assert zlib.crc32(b"") == 0


def test_packages_are_bounded(spark):
    pages = spark.createDataFrame([(i, None, "x" * i) for i in range(25)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "warc")
    written = scratch.keep(write_packages(pages, scratch.path("packages"), scratch, records_each=10), "packages").collect()
    assert sorted(r.n_records for r in written) == [5, 10, 10]
    assert sorted(r.page_id for r in read_packages(spark, written).collect()) == list(range(25))
