"""Streaming source `line_tail`: complete lines of growing text files, resumable at byte offsets.

`spark.readStream.format("line_tail").option("path", folder)` after `register(spark)`. The offset of a batch maps each
file to the byte after its last line break, so an unfinished last line waits for its rest. A file that shrank was
replaced and is read from its start. Byte ranges of up to `splitBytes` are separate partitions. Offsets live in the
query checkpoint. The folder may be a plain path or a URI of any file system that Arrow opens (file, hdfs, s3 and others); a
folder that does not exist is an error. `modified` is the file's time, so lines of several files have an order of arrival.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, value string, modified long"
PROBE = 1 << 16


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    limit: int
    modified: int = 0


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or a URI, in Hadoop's spellings too."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))


def complete_until(uri: str) -> int:
    """Byte position after the last line break of a file."""
    store, path = located(uri)
    with store.open_input_file(path) as f:
        end = f.size()
        while end > 0:
            begin = max(0, end - PROBE)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


def read_range(part: ByteRange) -> Iterator[tuple]:
    """Lines that start inside the range; a line begun there is followed past the range's end."""
    store, path = located(part.path)
    with store.open_input_file(path) as raw, io.BufferedReader(raw) as f:
        pos = part.start
        if pos > 0:
            f.seek(pos - 1)
            if f.read(1) != b"\n":
                pos += len(f.readline())
        f.seek(pos)
        while pos < part.end:
            line = f.readline(part.limit - pos)
            if not line:
                return
            text = line.rstrip(b"\r\n")
            if text.strip():
                yield part.path, pos, text.decode("utf-8", "replace"), part.modified
            pos += len(line)


class LineTailReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self._root = options["path"]
        self._split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def _files(self) -> dict[str, int]:
        """URI or path of each file, as it was given, with its time in nanoseconds."""
        store, path = located(self._root)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"line_tail: {self._root} does not exist")
        if info.is_file:
            return {self._root: info.mtime_ns or 0}
        found = store.get_file_info(fs.FileSelector(path))
        root = self._root.rstrip("/")
        return {f"{root}/{i.base_name}": i.mtime_ns or 0 for i in sorted(found, key=lambda i: i.path) if i.is_file and not i.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: complete_until(p) for p in self._files()}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out, times = [], self._files()
        for path, stop in end.items():
            begin = start.get(path, 0)
            if begin > stop:  # the file was replaced
                begin = 0
            for lo in range(begin, stop, self._split):
                out.append(ByteRange(path, lo, min(lo + self._split, stop), stop, times.get(path, 0)))
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        return None


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTail)
