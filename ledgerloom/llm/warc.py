"""Legacy archive converter: ARC records to WARC records, written as archive files and read back.

An ARC file begins with a version record (`filedesc://`), whose second line gives the version and whose third line
names the fields of every record header: five in version 1, ten in version 2, the declared length last. Each record
becomes a WARC response with a synthesised identifier (from archive name and offset), timestamp, media type and
payload digest; the version record becomes a warcinfo. A record whose payload equals that of a record with a smaller
page id becomes a revisit, which keeps the HTTP header and refers to the response.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import sliced
from ledgerloom.session import materialise, tune, work_dir

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: Bytes and records of one ARC archive.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 4 << 20, 1000
#: Uncompressed bytes after which a WARC file ends; a larger record has a file to itself.
WARC_BYTES = 16 << 20
DATE = "20240101000000"
#: What closes a WARC record.
END = b"\r\n\r\n"
#: Fields of a record header by version, as the version record declares them.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Rows that are handed on at once: pages, whole archives and whole WARC files; and bytes of a row group of archives.
BATCH_ROWS, GROUP_BYTES = 8, 4 * ARCHIVE_BYTES
RECORD = "archive string, start long, page_id long, uri string, date string, media string, head binary, payload binary, record_id string, digest string"


class ArcRecord(NamedTuple):
    start: int
    uri: str
    date: str
    media: str
    body: bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_archive(name: str, version: int, entries: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, network document) entries."""
    head = f"{version} 0 ledgerloom\n{' '.join(FIELDS[version])}\n\n".encode()
    out = [_arc_header(name, version, f"filedesc://{name}.arc", "text/plain", len(head)), head, b"\n"]
    for url, body in entries:
        out += [_arc_header(name, version, url, "text/html", len(body)), body, b"\n"]
    return b"".join(out)


def _arc_header(name: str, version: int, url: str, media: str, length: int) -> bytes:
    value = {"URL": re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) or "-", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": media, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": f"{name}.arc", "Archive-length": str(length)}
    return (" ".join(value[f] for f in FIELDS[version]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version record first. Header fields are those the version record declares."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc://"):  # the declaration that follows fixes the fields of this header too
            body = data[end + 1 :].split(b"\n", 2)
            fields = body[1].decode().split()
        # A url may hold blanks: the other fields are counted from the right.
        values = dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True))
        start, length = end + 1, int(values["Archive-length"])
        if start + length > len(data):
            raise ValueError(f"record at {at} declares {length} bytes beyond the end of the archive")
        yield ArcRecord(at, values["URL"], values["Archive-date"], values["Content-type"], data[start : start + length])
        at = start + length


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(name, archive): ARC files of the pages, of both versions in turn; the payload is the html in UTF-8.

    Written once: an archive's name is its task and its number in it, so that no two archives, and no two records, are
    one, whatever they hold.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[str, bytes]] = []
        size = count = 0

        def archive() -> pa.RecordBatch:
            name = f"ledgerloom-{TaskContext.get().partitionId():06d}-{count:06d}"
            return pa.record_batch({"name": pa.array([name]), "archive": pa.array([arc_archive(name, 1 + count % 2, entries)], pa.binary())})

        for batch in batches:
            for part in sliced(batch, ARCHIVE_RECORDS):
                for page, url, html in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    body = html or b""
                    mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                    entries.append((url.decode("utf-8", "replace") if url else "-", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body))
                    size += len(body)
                    if size >= ARCHIVE_BYTES or len(entries) >= ARCHIVE_RECORDS:
                        yield archive()
                        entries, size, count = [], 0, count + 1
        if entries:
            yield archive()

    return materialise(pages.select(F.col("page_id").cast("long"), F.col("url").cast("binary"), F.col("html").cast("binary").alias("html")).mapInArrow(packed, "name string, archive binary"), options={"parquet.block.size": str(GROUP_BYTES)})


def convert(archives: DataFrame) -> DataFrame:
    """The records of ARC files (name, archive) with what WARC asks for; version records are left to `write_warc`."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(batch.column(i) for i in range(2)), strict=True):
                rows = []
                for r in parse_arc(data.as_py()):
                    if r.uri.startswith("filedesc://"):
                        continue
                    head, _, payload = r.body.partition(b"\r\n\r\n")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
                    date = f"{r.date[:4]}-{r.date[4:6]}-{r.date[6:8]}T{r.date[8:10]}:{r.date[10:12]}:{r.date[12:14]}Z"
                    rows.append((name.as_py(), r.start, int(page[1]) if page else None, r.uri, date, r.media, head, payload, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{r.start}:{r.uri}')}>", sha1_base32(payload)))
                columns = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.binary(), pa.binary(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

    return archives.mapInArrow(parsed, RECORD)


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, target, target_uri, target_date) of the records that revisit an equal payload of a smaller page id."""
    heads = materialise(records.where(F.octet_length("payload") >= min_bytes).select("record_id", "page_id", "uri", "date", "digest"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    first = heads.groupBy("digest").agg(F.min_by(F.struct("record_id", "uri", "date"), order).alias("first"), F.count("*").alias("c")).where("c > 1")
    return materialise(heads.join(first, "digest").where("record_id <> first.record_id").select("record_id", F.col("first.record_id").alias("target"), F.col("first.uri").alias("target_uri"), F.col("first.date").alias("target_date")))


def write_warc(records: DataFrame, revisit: DataFrame, path: str, file_bytes: int = WARC_BYTES) -> None:
    """Write the records as gzipped WARC/1.1 files of about `file_bytes` before compression, each with a warcinfo record first."""

    def block(kind: str, fields: dict[str, str], content: bytes) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = 0
        for batch in batches:
            for part in sliced(batch, 500):
                for r in part.to_pylist():
                    fields = {"WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["uri"], "WARC-Date": r["date"], "WARC-Payload-Digest": "sha1:" + r["digest"], "WARC-Identified-Payload-Type": r["media"], "Content-Type": "application/http; msgtype=response"}
                    if r["target"] is None:
                        record = block("response", fields, r["head"] + b"\r\n\r\n" + r["payload"])
                    else:
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": r["target"], "WARC-Refers-To-Target-URI": r["target_uri"], "WARC-Refers-To-Date": r["target_date"]}
                        record = block("revisit", fields, r["head"] + b"\r\n\r\n")
                    if out and size + len(record) > file_bytes:
                        yield pa.record_batch({"value": pa.array([END.join(out)], pa.binary())})
                        out, size = [], 0
                    if not out:
                        out.append(block("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info:' + r['record_id'])}>", "WARC-Date": r["date"], "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\nsoftware: ledgerloom ARC converter\r\n"))
                    out.append(record)
                    size += len(record)
        if out:
            yield pa.record_batch({"value": pa.array([END.join(out)], pa.binary())})

    # One row is one file; the line separator closes its last record, as the format asks; bytes pass through unchanged.
    rows = records.join(revisit, "record_id", "left").mapInArrow(written, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {start} does not end where its length says")
        at += 4


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, record_id, target) of every record but the warcinfos.

    `files` has the column content, gzipped. A response's digest is that of its bytes and has to agree with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(zlib.decompress(content.as_py(), 31)):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its header")
                    rows.append((int(page[1]) if page else None, length, digest, kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "target"])

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, target string")


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Batches of few rows for what runs meanwhile, as thousands of pages or archives at once fill an executor."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(BATCH_ROWS))
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives written.

    `pages` has page_id, url and html; other columns are ignored. Null html has the empty payload, a null url the
    target `-`. Rows that repeat a page_id are records of their own, of which one at most is the response of a payload; a
    null page_id comes after all others. No pages give no archives and no rows.
    """
    spark = tune(pages.sparkSession)
    path = os.path.join(work_dir(spark), f"warc-{uuid.uuid4().hex}")
    with few_rows(spark):
        records = convert(pages_to_arc(pages))
        write_warc(records, revisits(records, min_bytes), path)
        rows = materialise(read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")))
    target = rows.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    return rows.join(target, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY hex) AS f FROM b)"""
