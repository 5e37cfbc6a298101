"""Legacy archives: ARC to WARC, with revisit records, and back to rows.

ARC records are a header line, whose fields depend on the archive's version, and as many
bytes as the line's last field declares. The converter reads both versions and makes
equivalent WARC records: ids from what they hold, ISO timestamps from 14 digits, types,
SHA-256 digests. Of records with equal payloads the one with the smallest page id is the
response and the others revisit it.

Each WARC record is a gzip member. Members are gathered to pieces of bounded bytes, and
files hold a bounded number of pieces, so files are bounded in bytes whatever the pages'
sizes (a page larger than a piece is one). Spark's text writer writes pieces as they are;
its line separator is an empty gzip member, so a file is a sequence of members. It
commits task by task in the shared folder, so a lost executor leaves no half archive.
Files are read member by member. Payloads are shuffled once, by page id, never by digest;
equal payloads meet as counted digests only.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = b"\r\n"
#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Bytes of a segment of ARC records and of a piece of a WARC file, pieces of a file.
SEGMENT_BYTES, PIECE_BYTES, FILE_PIECES = 4 << 20, 4 << 20, 16
#: A gzip member of no bytes.
EMPTY = gzip.compress(b"", mtime=0)
#: The fields of a record's header line, by archive version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
DATE = "20200101000000"
_IDS = uuid.UUID("6d1f0c1e-2f4b-5a8e-9c57-3b1c0d9e7a42")


def _escaped(url: str | None) -> str:
    """A url without white space or control characters, as a header line needs it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_header(version: int, name: str = "pages.arc") -> bytes:
    """The version block that opens an archive."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 Foliograph\n{names[version]}\n\n".encode()
    rest = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {rest}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One record; the document is an HTTP response that also tells the page id."""
    told = "" if page_id is None else str(page_id)
    document = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {told}\r\n\r\n".encode() + payload
    rest = "" if version == 1 else f"200 {zlib.crc32(payload):08x} - 0 pages.arc "
    return f"{_escaped(url)} 0.0.0.0 {DATE} text/html {rest}{len(document)}\n".encode() + document + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive, without its version block.

    The version comes from the block's first line (1 without a block). A line with too
    few fields or no length, or a document that is cut off, is an error that tells the
    place: nothing says where the next record would start.
    """
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        opening = line.startswith("filedesc://")
        names = ("length",) if opening else ARC_FIELDS[version]
        fields = line.rsplit(" ", 1)[1:] if opening else line.rsplit(" ", len(names) - 1)
        if end < 0 or len(fields) != len(names) or not re.fullmatch("[0-9]+", fields[-1]):
            raise ValueError(f"the header line at byte {at} of an archive is damaged")
        record = dict(zip(names, fields, strict=True))
        document = data[end + 1 : end + 1 + int(record["length"])]
        if len(document) < int(record["length"]):
            raise ValueError(f"the record at byte {at} of an archive is cut off")
        if opening:
            version = 2 if document[:1] == b"2" else 1
        else:
            yield record | {"document": document}
        at = end + 1 + len(document)


def http_parts(document: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of an HTTP response; without headers all is payload."""
    if not document.startswith(b"HTTP/"):
        return {}, document
    head, found, payload = document.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload if found else b""


def arc_segments(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(segment binary): ARC archives of the pages, versions 1 and 2 in turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = parts or [arc_header(version)]
                parts.append(arc_record(version, page_id, url, (html or "").encode()))
                size += len(parts[-1])
                if size >= segment_bytes:
                    yield pa.record_batch({"segment": pa.array([b"".join(parts)], pa.binary())})
                    version, parts, size = 3 - version, [], 0
        if parts:
            yield pa.record_batch({"segment": pa.array([b"".join(parts)], pa.binary())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, "segment binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(segment binary) of ARC files, plain or gzip."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("segment"))


def _members(data: bytes) -> Iterator[bytes]:
    """The plain bytes of each gzip member, one after the other; plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    while len(view):
        one, out, at = zlib.decompressobj(31), [], 0
        while not one.eof and at < len(view):  # in steps, so that what is left isn't copied for each member
            out.append(one.decompress(view[at : at + 65536]))
            at += 65536
        if not one.eof:
            raise ValueError("an archive is cut off")
        yield b"".join(out)
        view = view[min(at, len(view)) - len(one.unused_data) :]


def arc_records(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, date, mime, payload_bytes, payload_digest[, payload]) of each record."""
    schema = "page_id long, url string, date string, mime string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0):
                found = []
                for r in parse_arc(b"".join(_members(segment.as_py() or b""))):
                    headers, payload = http_parts(r["document"])
                    own = headers.get("x-page-id", "")
                    page_id = int(own) if own.lstrip("-").isdigit() else None
                    d = r["date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    found.append((page_id, r["url"], date, r["mime"], len(payload), hashlib.sha256(payload).hexdigest(), *[payload] * with_payload))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)

    return segments.mapInArrow(rows, schema)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str, date: str, mime: str, size: int, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """A response, or a revisit if refers_to is given; without the closing line ends."""
    told = "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {size}\r\nX-Page-Id: {told}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF + block


def revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that revisit another."""
    own = records.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest").distinct()
    first = own.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(first, "payload_digest").where("page_id != refers_to")


def warc_records(records: DataFrame, seen: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(value string) pieces of gzip members, one for each ARC record's WARC record; seen
    as revisits() gives it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                record = warc_record(*(c[k].as_py() for c in batch.columns))
                found.append(gzip.compress(record + CRLF + CRLF, 6, mtime=0))
                size += len(found[-1])
                if size >= piece_bytes:
                    yield pa.record_batch({"value": pa.array([b"".join(found)], pa.binary())})
                    found, size = [], 0
        if found:
            yield pa.record_batch({"value": pa.array([b"".join(found)], pa.binary())})

    both = records.join(seen, ["page_id", "payload_digest"], "left")
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")
    return both.select("page_id", "url", "date", "mime", "payload_bytes", "payload_digest", "refers_to", payload).mapInArrow(rows, "value binary").select(F.col("value").cast("string"))


def write_warc(records: DataFrame, path: str, file_pieces: int = FILE_PIECES) -> None:
    """Write pieces of WARC records to a folder of gzip archives."""
    records.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_pieces).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, warc_date, record_id, payload_bytes, payload_digest, record_type, refers_to)
    of the records of a folder of archives. Digests of responses are counted again; a
    record that doesn't match its own header is an error."""
    names = ("page_id", "url", "warc_date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = []
                for headers, block in (r for member in _members(content.as_py()) for r in parse_warc(member)):
                    http, payload = http_parts(block)
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"record {headers['warc-record-id']} is damaged")
                    own, other = http.get("x-page-id", ""), headers.get("x-refers-to-page")
                    found.append((int(own) if own else None, headers["warc-target-uri"], headers["warc-date"], headers["warc-record-id"], int(http["content-length"]), digest, kind, int(other) if other else None))
                yield pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, schema)


def convert_pages(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages through ARC archives into WARC archives under path, read back.

    A null html is an empty payload and a null url becomes "-". Rows given twice with
    one page_id are both written: both responses, or both revisits of a smaller page. A
    null page_id is a response of its own. An empty table gives no rows.
    """
    segments = arc_segments(pages)
    seen = revisits(arc_records(segments, with_payload=False), least_bytes)
    write_warc(warc_records(arc_records(segments), seen), path)
    return read_warc(pages.sparkSession, path)


CONVERTED_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), sized AS (SELECT page_id, html, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p
), told AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id > first THEN first END AS refers_to FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM told
"""
