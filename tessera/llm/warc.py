"""Web archives in ZIP packages: writing pages as WARC records and reading them back by range.

A package holds stored members: ``archive/data.warc.gz`` (each record its own gzip member) and
``indexes/index.cdxj`` (a line for each record with its offset and length). Equal payloads are stored once: the page
with the largest page_id is the response, others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.files import make_dirs, open_read, open_write, size_of
from tessera.llm.zip_archive import ZipReader, ZipWriter

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shared payloads up to which the list of their responses is sent to all executors (about 16 MB); beyond it is shuffled.
BROADCAST_ROWS = 200_000
#: Records of a package at most.
PACKAGE_RECORDS = 50_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:tessera:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    tail = record_id.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, not compressed."""
    target = _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url or "urn:tessera:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    size = int(re.search(rb"(?i)\r\nContent-Length: *([0-9]+)", http)[1])
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    refers = fields.get("warc-refers-to")
    return {"page_id": _page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else _page_of(refers), "payload": payload if kind == "response" else None}


def _referring(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """``page_id, url, html, refers_to``: the response's page_id for pages that revisit another."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    small = rows.filter(F.octet_length("html") >= least).select(digest.alias("digest"), "page_id")
    shared = small.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).filter("n > 1 and response_id is not null").drop("n")
    shared = scratch.keep(shared, "shared")
    count = shared.count()
    if not count:
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    shared = F.broadcast(shared) if count <= BROADCAST_ROWS else shared
    met = rows.withColumn("digest", digest).join(shared, "digest", "left")
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0, level: int = 1, records_each: int = PACKAGE_RECORDS) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as packages of at most ``records_each`` below ``folder``, whose index a
    task holds while it writes one; returns ``path, n_records``.

    Payloads of fewer than ``least`` bytes are always responses. A task that runs twice writes two packages; the
    returned rows name one of them, so materialise them once and read by them.
    """
    rows = _referring(pages, scratch, least)
    make_dirs(pages.sparkSession, folder)

    def package(pages) -> tuple[str, int]:
        path, lines = f"{folder}/{uuid.uuid4().hex}.wacz", []

        def records():
            at = 0
            for page_id, url, html, refers_to in pages:
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, html.encode(), refers_to)) + packer.flush()
                lines.append(json.dumps({"id": page_id, "offset": at, "length": len(raw)}) + "\n")
                at += len(raw)
                yield raw

        with open_write(path) as out:
            made = ZipWriter(out)
            made.member(DATA, records())
            made.member(INDEX, (x.encode() for x in lines))
            made.member("datapackage.json", [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [DATA, INDEX]}).encode()])
            made.close()
        return path, len(lines)

    def run(batches):
        pages = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for first in pages:
            path, n = package(chain([first], islice(pages, records_each - 1)))
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return rows.mapInArrow(run, "path string, n_records long")


_FIELDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read_packages(spark: SparkSession, packages: list, with_payload: bool = False) -> DataFrame:
    """One row per record of the packages listed (rows with ``path``), each read by its range from the index."""
    names = [n for n in _FIELDS if with_payload or n != "payload"]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                size = size_of(path)
                with open_read(path) as source:
                    package = ZipReader(source, size)
                    entries = [json.loads(x) for x in package.read(INDEX).splitlines()]
                    for a in range(0, len(entries), 64):
                        found = [parse_record(zlib.decompress(package.read(DATA, e["offset"], e["length"]), 31)) for e in entries[a : a + 64]]
                        yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], _FIELDS[n]) for n in names], names=names)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    rows = spark.createDataFrame([(p.path,) for p in packages], "path string").repartition(max(1, len(packages)))
    return rows.mapInArrow(run, kind)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as packages in the shared folder and read every record back (see ``read_packages``).

    Null html is an empty payload; a null url gets a stand-in; a null page_id is kept and is never a response for
    others; of repeated rows with the largest page_id each is a response. Empty tables give no rows. Other columns
    are not read. The packages are deleted once read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    packages = scratch.keep(write_packages(pages, scratch.path("packages"), scratch, least), "packages").collect()  # a row per package
    out = scratch.keep(read_packages(spark, packages), "records")
    scratch.drop(scratch.path("packages"))
    return out
