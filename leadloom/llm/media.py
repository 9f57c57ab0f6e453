"""Media columns: payloads stored once under their digest in tar shards; rows carry digest, shard, offset and length.

A payload becomes an 8-bit grey PNG image, WIDTH samples wide, whose samples are the payload's bytes. Its tar member is named by its
SHA-256. Each task writes shards of its own and stores equal payloads once in it. Rows hold where their media stand, so metadata columns come from range reads of the first
33 bytes (signature and IHDR), and payloads from range reads of one member, without scanning a shard.

Defined cases: null text is empty; a text of any length is stored whole; equal texts have equal values in every column but place; repeated rows
share a member; an empty table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table
from .files import Rolling, open_fs

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, media_bytes long"


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey PNG of 8-bit samples; len(payload) is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    lines = bytearray((WIDTH + 1) * rows)  # each line begins with filter type 0
    for i in range(rows):
        lines[i * (WIDTH + 1) + 1 : (i + 1) * (WIDTH + 1)] = payload[i * WIDTH : (i + 1) * WIDTH]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(bytes(lines), level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return width, height, depth, colour


def decode(data: bytes) -> bytes:
    width, rows, depth, colour = header(data)
    if (depth, colour) != (8, 0):
        raise ValueError("only grey images of 8 bits are stored here")
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = zlib.decompress(b"".join(packed))
    return b"".join(lines[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(rows))


def tar_member(name: str, data: bytes) -> tuple[bytes, int]:
    """(member, where its data begin in it) in the ustar format."""
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % len(data)), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head) + data + b"\0" * (-len(data) % 512), 512


def _store(folder: str, most: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("media_bytes", pa.int64())])
        out, places = Rolling(folder, ".tar", most, tail=b"\0" * 1024), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, rows = batch.slice(start, 512), []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    text = text or b""
                    payload = padded(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        media = encode(payload)
                        member, skip = tar_member(f"{digest}.png", media)
                        shard, at = out.put(member)
                        if len(places) >= 200_000:  # a bound on memory only: a payload may then be stored again
                            places.clear()
                        places[digest] = (shard, at + skip, len(media))
                    shard, at, size = places[digest]
                    rows.append({"doc_id": i, "n_bytes": len(text), "digest": digest, "shard": shard, "offset": at, "media_bytes": size})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        out.close()

    return run


def store(docs: DataFrame, folder: str, most: int = 256 << 20) -> DataFrame:
    """Write the shards; returns doc_id, n_bytes, digest, shard, offset, media_bytes of each row, checkpointed, so that they're written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_store(folder, most), INDEX).checkpoint()


def _ranges(batches, function, kinds, size):
    """Add function(bytes of a range) to each row, opening each shard once in a run of its rows; size(row) is the length of the range."""
    import pyarrow as pa

    shard, file, last, value = None, None, None, None
    names = list(kinds)
    for batch in batches:
        got = {c: [] for c in names}
        for name, at, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes"))):
            if name != shard:
                if file:
                    file.close()
                fs, path = open_fs(name)
                shard, file = name, fs.open_input_file(path)
            if (name, at) != last:
                last, value = (name, at), function(file.read_at(size(length), at))
            for c, v in zip(names, value):
                got[c].append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[c], kinds[c]) for c in names)], names=[*batch.schema.names, *names])
    if file:
        file.close()


def _headers(batches):
    import pyarrow as pa

    yield from _ranges(batches, header, {c: pa.int32() for c in ("width", "height", "bit_depth", "colour_type")}, lambda n: HEADER)


def with_metadata(index: DataFrame) -> DataFrame:
    """index with width, height, bit_depth and colour_type, from the first bytes of each member."""
    return index.mapInArrow(_headers, f"{_ddl(index)}, width int, height int, bit_depth int, colour_type int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def measure(media: bytes) -> tuple:
    import numpy as np

    payload = decode(media)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = int((counts * np.arange(256)).sum()) / len(payload)
    feature = f"mean={mean:.4f};levels={len(p)};entropy={float(-(p * np.log2(p)).sum()):.4f};peak={int(counts.argmax())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), feature


def _payloads(batches):
    import pyarrow as pa

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    yield from _ranges(batches, measure, kinds, lambda n: n)


def with_payloads(index: DataFrame) -> DataFrame:
    """index with the payload's length, digests and features, from a range read of each member."""
    return index.mapInArrow(_payloads, f"{_ddl(index)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(table(spark, sf_dir, "documents"), fresh_path(spark, "media"))
    rows = with_payloads(with_metadata(index))
    feature = F.concat_ws(";", F.concat(F.lit("png:"), F.col("width"), F.lit("x"), F.col("height"), F.lit("x"), F.col("bit_depth")), F.col("feature"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
