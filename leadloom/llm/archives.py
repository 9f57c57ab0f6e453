"""WARC: a converter of legacy ARC archives, with revisit records for repeated payloads, and a reader of WARC files.

ARC: a file begins with a version block, whose first line is a `filedesc:` record header and whose body names the version and its fields. Version 1
headers are `URL IP date type length`, version 2 headers `URL IP date type status checksum location offset file length`; the
declared length tells where a record ends. The block of an http record is the response as it was sent.

WARC: each ARC record becomes a `response` (or a `revisit`) with identifiers, dates, types and digests that follow from the ARC record alone: the
record id is a UUID (version 8) that holds the record's key, WARC-Date is the ARC date, the payload is what follows the http header, and digests
are SHA-1. Records are gzip members of their own, in files of a bounded size in the shared folder.

Revisits: of records with equal payloads of at least LEAST bytes the one with the largest key is the response. Digests are combined before
they are shuffled; payloads are shuffled only if the table of repeated digests is too large to be broadcast by its true size.

Defined cases: null payload is empty; null url becomes `urn:x-no-url`; white space and control characters in a url are percent-encoded; a null key
gets the nil UUID and reads back as null; repeated keys give repeated records; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, table
from .files import Rolling, open_fs

LEAST = 1000
CRLF = b"\r\n"
#: Field names of a version block, as the format fixes them.
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NIL = "00000000-0000-0000-0000-000000000000"
SEGMENT = 4 << 20


@dataclass
class Record:
    url: str
    ip: str
    date: str
    mime: str
    header: bytes
    payload: bytes


# ARC -----------------------------------------------------------------------------------------------------------------


def _quoted(url: str | None) -> str:
    return "urn:x-no-url" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "urn:x-no-url"


def http_block(key: int | None, payload: bytes) -> bytes:
    keyed = b"" if key is None else b"X-Record-Key: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + keyed + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_file(rows, version: int, name: str = "pages.arc", date: str = "20260101000000") -> bytes:
    """A legacy archive of (key, url, payload) rows."""
    fields = FIELDS[version]
    body = b"%d 0 leadloom\n%s\n" % (version, fields)
    tail = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode(), body, b"\n"]
    at = sum(map(len, out))
    for key, url, payload in rows:
        block = http_block(key, payload)
        more = f" 200 {hashlib.md5(payload).hexdigest()} - {at} {name}" if version == 2 else ""
        record = f"{_quoted(url)} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"
        out.append(record)
        at += len(record)
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an archive of either version; raises ValueError where a header or a declared length is wrong."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not version:
            if not line.startswith("filedesc:"):
                raise ValueError("an archive begins with its version block")
            size = line.rpartition(" ")[2]
            block = data[end + 1 : end + 1 + int(size)]
            first = block.split(b" ", 1)[0]
            if first not in (b"1", b"2"):
                raise ValueError(f"version {first!r} is not known")
            version = int(first)
            at = end + 1 + int(size)
            continue
        parts = line.rsplit(" ", 4 if version == 1 else 9)
        if len(parts) != (5 if version == 1 else 10) or not parts[-1].isdigit():
            raise ValueError(f"a header of version {version} is wrong at byte {at}")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is shorter than it declares")
        header, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        yield Record(parts[0], parts[1], parts[2], parts[3], header + gap, payload)
        at = end + 1 + size


# WARC ----------------------------------------------------------------------------------------------------------------


def record_id(key: int | None) -> str:
    """A version 8 UUID that holds a 64-bit key: two bits in the second custom part, 62 in the third."""
    if key is None:
        return NIL
    k = key & 0xFFFFFFFFFFFFFFFF
    x = (0x6C6561646C6D << 80) | (8 << 76) | ((k >> 62) << 64) | (2 << 62) | (k & ((1 << 62) - 1))
    h = f"{x:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def record_key(uuid: str) -> int | None:
    if uuid == NIL:
        return None
    x = int(uuid.replace("-", ""), 16)
    k = ((x >> 64) & 3) << 62 | (x & ((1 << 62) - 1))
    return k - (1 << 64) if k >> 63 else k


def _digest(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def header_key(header: bytes) -> int | None:
    m = re.search(rb"\r\nX-Record-Key: (-?\d+)\r\n", header)
    return int(m[1]) if m else None


def warc_record(r: Record, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of the record with key refers_to."""
    key = header_key(r.header)
    block = r.header if refers_to is not None else r.header + r.payload
    d = r.date.ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:uuid:{record_id(key)}>".encode(),
        f"WARC-Date: {date}".encode(), f"WARC-Target-URI: {r.url}".encode(), f"WARC-IP-Address: {r.ip}".encode(),
        b"Content-Type: application/http; msgtype=response" if r.header else f"Content-Type: {r.mime}".encode(),
        b"WARC-Payload-Digest: " + _digest(r.payload), b"WARC-Block-Digest: " + _digest(block),
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{record_id(refers_to)}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Truncated: length"]
    lines.append(b"Content-Length: %d" % len(block))
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def read_warc(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, whose gzip members are records; memory holds one record."""
    rest, member, d = b"", [], None
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            break
        d = d or zlib.decompressobj(31)
        member.append(d.decompress(data))
        if d.eof:
            rest, d = d.unused_data, None
            whole, member = b"".join(member), []
            head, _, body = whole.partition(CRLF * 2)
            headers = dict(x.decode("utf-8", "replace").split(": ", 1) for x in head.split(CRLF)[1:])
            yield headers, body[: int(headers["Content-Length"])]
    if d is not None:
        raise ValueError("a member is cut off")


# DataFrames ----------------------------------------------------------------------------------------------------------

PARSED = "key long, url string, ip string, date string, mime string, header binary, payload binary, digest string, bytes long"


def _segments(batches):
    """Batches of (page_id, url, payload) as ARC files of about SEGMENT bytes, of the two versions in turn."""
    import pyarrow as pa

    schema, n = pa.schema([("content", pa.binary())]), 0
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload"))):
            rows.append(row)
            size += len(row[2])
            if size >= SEGMENT:
                yield pa.RecordBatch.from_pydict({"content": [arc_file(rows, 1 + n % 2)]}, schema=schema)
                rows, size, n = [], 0, n + 1
        if rows:
            yield pa.RecordBatch.from_pydict({"content": [arc_file(rows, 1 + n % 2)]}, schema=schema)
            n += 1


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Legacy archives (content) of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.mapInArrow(_segments, "content binary")


def _parsed(batches):
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64())])
    for batch in batches:
        for content in batch.column("content"):
            rows = [{"key": header_key(r.header), "url": r.url, "ip": r.ip, "date": r.date, "mime": r.mime, "header": r.header, "payload": r.payload, "digest": hashlib.sha1(r.payload).hexdigest(), "bytes": len(r.payload)} for r in parse_arc(content.as_py())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _written(folder: str, most: int):
    def run(batches):
        import pyarrow as pa

        counts: dict[str, int] = {}
        out = Rolling(folder, ".warc.gz", most)
        names = ["url", "ip", "date", "mime", "header", "payload"]
        for batch in batches:
            for *values, refers in zip(*(batch.column(c).to_pylist() for c in [*names, "refers_to"])):
                name, _ = out.put(gzip_member(warc_record(Record(*values), refers)))
                counts[name] = counts.get(name, 0) + 1
        out.close()
        if counts:
            yield pa.RecordBatch.from_pydict({"file": list(counts), "records": list(counts.values())}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return run


def convert_archives(archives: DataFrame, folder: str, least: int = LEAST, most: int = 64 << 20) -> DataFrame:
    """Convert ARC files (content) to WARC files in the folder; returns file and records, checkpointed, so that they're written once."""
    parsed = archives.mapInArrow(_parsed, PARSED)
    large = F.col("bytes") >= least
    repeated = parsed.where(large).groupBy("digest").agg(F.max("key").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner")
    repeated = materialize(repeated, "digests")
    # payloads too small to be revisited get keys of their own, or they would meet in one task
    keyed = parsed.withColumn("at", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.col("digest")))))
    marked = keyed.join(repeated.select(F.col("digest").alias("at"), "winner"), "at", "left")
    marked = marked.select("url", "ip", "date", "mime", "header", "payload", F.when(F.col("winner") != F.col("key"), F.col("winner")).alias("refers_to"))
    return marked.mapInArrow(_written(folder, most), "file string, records long").checkpoint()


READ = "record_id string, key long, record_type string, date string, url string, payload_bytes long, payload_digest string, refers_to long"


def _read(batches):
    import pyarrow as pa

    schema = pa.schema([("record_id", pa.string()), ("key", pa.int64()), ("record_type", pa.string()), ("date", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    uuid = lambda x: x[10:-1]  # noqa: E731  <urn:uuid:...>
    for batch in batches:
        for name in batch.column("file").to_pylist():
            fs, path = open_fs(name)
            rows = []
            with fs.open_input_stream(path) as stream:
                for h, block in read_warc(stream):
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
                    header, gap, payload = block.partition(CRLF * 2)
                    if h["WARC-Type"] == "response":
                        size = len(payload)
                        if hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} has another payload than its digest says")
                    else:  # a revisit keeps the http header, which has the length of the payload
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", header + gap)[1])
                    refers = h.get("WARC-Refers-To")
                    rows.append({"record_id": uuid(h["WARC-Record-ID"]), "key": record_key(uuid(h["WARC-Record-ID"])), "record_type": h["WARC-Type"], "date": h["WARC-Date"], "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest.hex(), "refers_to": record_key(uuid(refers)) if refers else None})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of WARC files (file)."""
    return files.select("file").mapInArrow(_read, READ)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = convert_archives(pages_to_arc(table(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    return read_archives(files).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> last THEN last END AS refers_to FROM q
"""
