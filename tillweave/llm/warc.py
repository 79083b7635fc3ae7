"""Legacy web archives: ARC files to WARC files, and readers and writers for both.

ARC has two header forms, named in the first record of a file:

* version 1: ``URL IP date content-type length``
* version 2: ``URL IP date content-type result-code checksum location offset filename length``

The converter takes records by their declared lengths and makes the WARC fields that ARC lacks: record ids
(UUIDs of the record's own fields, so a rerun gives the same), timestamps, record types and digests. Files are
written and read through Spark's sources, so any shared file system serves; a file holds about ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm.common import materialize
from tillweave.session import scratch_folder

#: Compressed records are gathered to files of about this size; a larger record has a file of its own.
FILE_BYTES = 8 << 20
#: Bytes of records in one Arrow batch that a reader hands on.
BATCH_BYTES = 4 << 20
#: Fixed texts of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_ID = "X-Page-Id"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def digest32(body: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


# ARC


def arc_file_head(version: int, name: str) -> bytes:
    """The record that opens an ARC file and names its version."""
    body = f"{version} 0 tillweave\n{ARC_FIELDS[version]}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", "20240101000000", "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return f"{' '.join(fields)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, status: str, offset: int, name: str, body: bytes) -> bytes:
    """One ARC record: header line, block of the declared length, line feed."""
    fields = [url, ip, date, mime]
    if version == 2:
        fields += [status, digest32(body), "-", str(offset), name]
    return f"{' '.join(fields)} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, without the file head.

    The version is the one the file head names; without one the number of fields decides. A URL may hold
    blanks, as the other fields are counted from the right. Where a header line or a length makes no sense,
    reading goes on at the next line.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        n = 5 if version == 1 else 10
        if not version:
            n = 10 if len(line.split(" ")) >= 10 else 5
        fields = line.rsplit(" ", n - 1)
        start = end + 1
        if len(fields) != n or not fields[-1].isdigit() or start + int(fields[-1]) > len(data):
            at = start
            continue
        length = int(fields[-1])
        body = data[start : start + length]
        if fields[0].startswith("filedesc://"):
            version = 1 if body[:1] == b"1" else 2
        else:
            yield {"url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3], "offset": at, "body": body}
        at = start + length


# WARC


def iso_time(stamp: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; anything else: the epoch."""
    digits = stamp if stamp.isdigit() and len(stamp) >= 8 else "19700101"
    d = digits[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_uuid(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(parts))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; names in lower case. Blocks are taken by their declared length."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers.get("content-length", "0"))
        yield headers, data[start:stop]
        at = data.find(b"WARC/", stop)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.strip().lower() == name.lower():
            return v.strip()
    return None


# Compression: one gzip member a record, as both formats have it


def packed(record: bytes) -> bytes:
    return gzip.compress(record, 6, mtime=0)


def unpacked(data: bytes) -> bytes:
    """A file's bytes, its members decompressed; plain files pass. One line feed after the last member is no part."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    end = len(data) - data.endswith(b"\n")
    with gzip.GzipFile(fileobj=io.BytesIO(data[:end])) as members:
        return members.read()


# Spark jobs


class _Files:
    """Gather records, each compressed, to file bodies of about FILE_BYTES."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> bool:
        part = packed(record)
        self.parts.append(part)
        self.size += len(part)
        return self.size >= FILE_BYTES

    def take(self) -> pa.RecordBatch:
        body, self.parts, self.size = b"".join(self.parts), [], 0
        return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])


def _write_files(bodies: DataFrame, folder: str) -> None:
    """One file per row; the text writer puts a line feed at the end, which both readers pass over."""
    lines = bodies.select(F.col("body").cast("string"))
    lines.write.option("maxRecordsPerFile", 1).text(folder)


def _read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("content")


def _clean(url: str | None) -> str:
    """A URL fit for a header line: blanks and control characters are escaped, null is ``about:blank``."""
    if not url:
        return "about:blank"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def write_arc(pages: DataFrame, folder: str, id_col: str, url_col: str, body_col: str) -> None:
    """Store pages as ARC files of both versions; the id travels in the stored HTTP head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {1: _Files(), 2: _Files()}
        for batch in batches:
            for page, url, body in zip(*batch.columns):
                page, body = page.as_py(), body.as_py() or b""
                version = 1 + (hashlib.md5(str(page).encode()).digest()[0] & 1)
                out = files[version]
                if not out.parts:
                    out.add(arc_file_head(version, f"pages-{version}.arc"))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                if page is not None:
                    head += f"{PAGE_ID}: {page}\r\n"
                block = head.encode() + b"\r\n" + body
                record = arc_record(
                    version, _clean(url.as_py()), "0.0.0.0", "20240101000000", "text/html", "200", out.size, f"pages-{version}.arc", block
                )
                if out.add(record):
                    yield out.take()
        for out in files.values():
            if out.parts:
                yield out.take()

    rows = pages.select(
        F.col(id_col).cast("string").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.col(body_col).cast("string").cast("binary").alias("body"),
    )
    _write_files(rows.mapInArrow(run, "body binary"), folder)


_ARC_SCHEMA = "url string, ip string, date string, mime string, page string, head binary, payload binary, digest string"


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ARC files of a folder: header fields, HTTP head, payload and its digest."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.string()]
        names = ["url", "ip", "date", "mime", "page", "head", "payload", "digest"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_arc(unpacked(content.as_py())):
                    head, payload = split_http(r["body"])
                    rows.append((r["url"], r["ip"], r["date"], r["mime"], http_field(head, PAGE_ID), head, payload, digest32(payload)))
                    size += len(r["body"])
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return _read_files(spark, folder).mapInArrow(run, _ARC_SCHEMA)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, id_type: str = "bigint", min_bytes: int = 0) -> None:
    """Convert a folder of ARC files to WARC files.

    Of records with equal payloads of at least ``min_bytes``, the one with the smallest page id is a response
    and the others are revisits that name it; smaller payloads are all responses. Rows that repeat the smallest
    id are all responses. Records without id come last; where no record of a payload has one, all are responses.
    """
    records = read_arc(spark, arc_folder).withColumn("page_key", F.col("page").cast(id_type))
    sizes = F.octet_length("payload")
    firsts = records.where(sizes >= min_bytes).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("page_key").alias("first_page"),
        F.min_by("url", "page_key").alias("first_url"), F.min_by("date", "page_key").alias("first_date"),
    )
    # Single payloads need no look-up, so they are left out: where few payloads repeat, payloads aren't shuffled.
    # Written, so that the join below knows its size, and else is of two plain shuffles and a hot digest can be split.
    firsts = firsts.where("copies > 1").drop("copies")
    firsts = materialize(firsts, "warc-firsts").withColumnRenamed("digest", "first_digest")
    joined = records.join(firsts, F.col("digest") == F.col("first_digest"), "left").select(
        "url", "ip", "date", "mime", "page", "head", "payload", "digest",
        F.col("first_page").cast("string").alias("first_page"), "first_url", "first_date",
        (F.col("first_page").isNotNull() & (sizes >= min_bytes) & ~F.col("page_key").eqNullSafe(F.col("first_page"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files()
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                head, payload = r["head"], r["payload"]
                block = head if r["revisit"] else head + payload
                mime = "application/http; msgtype=response" if head else r["mime"]
                kind = "revisit" if r["revisit"] else "response" if head else "resource"
                headers = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_uuid(r["url"], r["date"], r["page"] or "", r["digest"])),
                    ("WARC-Date", iso_time(r["date"])),
                    ("WARC-Target-URI", r["url"]),
                    ("WARC-IP-Address", r["ip"]),
                    ("WARC-Block-Digest", "sha1:" + digest32(block)),
                    ("WARC-Payload-Digest", "sha1:" + r["digest"]),
                    ("X-Payload-Length", str(len(payload))),
                    ("Content-Type", mime),
                ]
                if r["revisit"]:
                    headers += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", record_uuid(r["first_url"], r["first_date"], r["first_page"], r["digest"])),
                        ("WARC-Refers-To-Target-URI", r["first_url"]),
                        ("X-Refers-To-Page-Id", r["first_page"]),
                    ]
                if out.add(warc_record(headers, block)):
                    yield out.take()
        if out.parts:
            yield out.take()

    _write_files(joined.mapInArrow(run, "body binary"), warc_folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all WARC files of a folder.

    ``payload`` is null for revisits; ``payload_bytes`` and ``payload_digest`` are of the full payload: counted
    anew where the payload is there, from the header for revisits.
    """
    names = ["record_type", "record_id", "warc_date", "url", "page", "refers_to_id", "refers_to_page", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
    schema = ", ".join(f"{n} {'bigint' if k == pa.int64() else 'binary' if k == pa.binary() else 'string'}" for n, k in zip(names, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse_warc(unpacked(content.as_py())):
                    head, payload = split_http(block)
                    revisit = h.get("warc-type") == "revisit"
                    rows.append((
                        h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), http_field(head, PAGE_ID),
                        h.get("warc-refers-to"), h.get("x-refers-to-page-id"),
                        int(h.get("x-payload-length", "0")) if revisit else len(payload),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest32(payload),
                        None if revisit else payload,
                    ))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _read_files(spark, folder).mapInArrow(run, schema)


def pages_through_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: one row per page.

    A null body is an empty payload, a null URL ``about:blank``. Pages without id and repeated ids: see
    ``convert``. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    arc, out = scratch_folder(spark, "arc") + "/files", scratch_folder(spark, "warc") + "/files"
    write_arc(pages, arc, id_col, url_col, body_col)
    kind = pages.schema[id_col].dataType.simpleString()
    convert(spark, arc, out, kind, min_bytes)
    read = read_warc(spark, out)
    return read.select(
        F.col("page").cast(kind).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_page").cast(kind).alias("refers_to"),
        "record_id",
        "warc_date",
        "url",
    )
