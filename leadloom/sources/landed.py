"""A Spark data source for CSV results that may still be written: it gives the whole rows of each file, in batches or as a stream.

A row is whole when its line end has landed, outside of quotes; what comes after the last one is left for later, and so never read in half. A finished file whose last row has no line
end is read with the option `final`. Files are read by the executors in blocks, so a file needs the memory of a block and its longest row. A stream's offsets are (file, bytes seen):
a row belongs to the offset range that its line end lies in, so each row comes once, restarts included, however the file grew in between. A range's task counts the quotes before it
to know whether it starts inside of a quoted value.

    spark.dataSource.register(LandedListings)
    spark.read.format("landed_listings").load(folder)
    spark.readStream.format("landed_listings").load(folder)

Columns are those of LISTING by the names of each file's header, all strings, null where a file lacks them or a value is empty; `file` and `row_end` (the byte after the row) tell where a row
stands. Bytes that aren't UTF-8 come as U+FFFD.
"""

from __future__ import annotations

import csv
import io
import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAMES = ["title", "website", "address", "complete_address", "phone", "category", "place_id", "cid", "data_id"]
SCHEMA = ", ".join(f"{n} string" for n in NAMES) + ", file string, row_end long"
BLOCK = 8 << 20


def _open(uri: str):
    """(file system, path) of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> dict[str, int]:
    """Bytes of each CSV file: the given one, or those in the folder, but for hidden ones."""
    from pyarrow import fs

    system, path = _open(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=False))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(".csv") and not f.base_name.startswith(("_", "."))}


def whole_rows(stream, end: int, final: bool = False, block: int = BLOCK):
    """(bytes, ends) of the whole rows before byte `end`, block by block: ends are places in the file, the bytes are those of the rows between."""
    import numpy as np

    at, held, inside = 0, b"", 0
    while at < end:
        data = stream.read(min(block, end - at))
        if not data:
            break
        new = np.frombuffer(data, np.uint8)
        quoted = (np.cumsum(new == 34) + inside) & 1
        inside = int(quoted[-1])
        ends = np.flatnonzero((new == 10) & (quoted == 0)) + 1
        if len(ends):
            cut = int(ends[-1])
            yield held + data[:cut], (ends + at).tolist()
            held = data[cut:]
        else:
            held += data
        at += len(data)
    if final and held.strip() and not inside:
        yield held, [at]


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def read_range(uri: str, part: Range, final: bool, block: int = BLOCK):
    """Record batches of the rows whose ends lie in (start, end]."""
    import pyarrow as pa

    system, _ = _open(uri)
    header = None
    with system.open_input_stream(part.file) as stream:
        for data, ends in whole_rows(stream, part.end, final, block):
            rows, places = [], []
            skip = bisect_right(ends, part.start) if header is not None else 0  # rows of earlier ranges
            base = ends[-1] - len(data)
            text = data[(ends[skip - 1] if skip else base) - base :].decode("utf-8", "replace")
            parsed = csv.reader(io.StringIO(text, newline=""))
            for row, place in zip(parsed, ends[skip:]):
                if header is None:
                    header = {n.strip().lstrip("﻿"): i for i, n in enumerate(row)}
                elif place > part.start and row:
                    rows.append(row)
                    places.append(place)
            if rows:
                columns = []
                for n in NAMES:
                    i = header.get(n)
                    columns.append(pa.array([(r[i] or None) if i is not None and i < len(r) else None for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part.file] * len(rows), pa.string()), pa.array(places, pa.int64())], [*NAMES, "file", "row_end"])


class LandedReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.final = options["path"], options.get("final", "false").lower() == "true"

    def partitions(self):
        return [Range(f, 0, size) for f, size in sorted(listed(self.uri).items())] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.file:
            yield from read_range(self.uri, partition, self.final)


class LandedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.uri = options["path"]

    def initialOffset(self):  # noqa: N802  (Spark's names)
        return {"files": "{}"}

    def latestOffset(self):  # noqa: N802
        return {"files": json.dumps(listed(self.uri), sort_keys=True)}

    def partitions(self, start, end):
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [Range(f, before.get(f, 0), size) for f, size in sorted(now.items()) if size > before.get(f, 0)] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.file:
            yield from read_range(self.uri, partition, False)


class LandedListings(DataSource):
    @classmethod
    def name(cls):
        return "landed_listings"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LandedReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return LandedStream(self.options)


def read_landed(spark: SparkSession, path: str, final: bool = False) -> DataFrame:
    """The whole rows of the CSV files at path, as far as they have landed."""
    spark.dataSource.register(LandedListings)
    return spark.read.format("landed_listings").option("final", str(final).lower()).load(path)


def stream_landed(spark: SparkSession, path: str) -> DataFrame:
    """The whole rows of the CSV files in a folder as they land, each once."""
    spark.dataSource.register(LandedListings)
    return spark.readStream.format("landed_listings").load(path)
