"""Files in the shared folder, written and read by executors through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import os


def open_fs(uri: str):
    """(file system, path) of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Rolling:
    """Writes records to files of about `most` bytes. Each file has a name of its own for every attempt of a task, so an attempt that is
    lost or repeated leaves files that no result row names, and never harms another attempt's."""

    def __init__(self, folder: str, suffix: str, most: int = 256 << 20, head: bytes = b"", tail: bytes = b""):
        self.fs, self.folder = open_fs(folder)
        self.uri = folder.rstrip("/")
        self.suffix, self.most, self.head, self.tail = suffix, most, head, tail
        self.stream, self.name, self.at, self.count = None, "", 0, 0

    def _open(self) -> None:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"{task.partitionId():05d}-{task.taskAttemptId()}" if task else f"local-{os.getpid()}"
        self.name = f"part-{part}-{self.count}{self.suffix}"
        self.fs.create_dir(self.folder, recursive=True)
        self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        self.at, self.count = 0, self.count + 1
        if self.head:
            self.stream.write(self.head)
            self.at = len(self.head)

    def put(self, record: bytes) -> tuple[str, int]:
        """(file, offset) of the record."""
        if self.stream is None or self.at >= self.most:
            self.close()
            self._open()
        place = (f"{self.uri}/{self.name}", self.at)
        self.stream.write(record)
        self.at += len(record)
        return place

    def close(self) -> None:
        if self.stream is not None:
            if self.tail:
                self.stream.write(self.tail)
            self.stream.close()
            self.stream = None
