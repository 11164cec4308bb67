"""Event and record logs as a Spark data source: ``spark.read.format("eventlog")`` and ``spark.readStream``.

A log is a folder (or a file) of lines that are only ever appended. Rows are (file, position, line): the line's byte offset names
it for good, and no block before it needs to be read to know it; ``events.salvage`` takes such rows as they are. Files are
read in ranges of ``blockBytes``: a line belongs to the range that its first byte is in. A stream goes on from the sizes that
it has read, and takes complete lines alone; a last line without a newline waits, and is given by a batch read.

    eventlog.register(spark)
    events.salvage(spark.read.format("eventlog").load(path))

Files are opened by pyarrow's file systems, so a path may be local, ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "eventlog"
BLOCK_BYTES = 64 << 20
_CHUNK = 1 << 20


class Range(InputPartition):
    """The lines of a file whose first byte is in [start, end); ``size`` bounds what is read, and ``open_end`` takes a last
    line without a newline."""

    def __init__(self, path: str, start: int, end: int, size: int, open_end: bool):
        self.path, self.start, self.end, self.size, self.open_end = path, start, end, size, open_end


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the log's files, sorted; hidden ones and those that a writer has marked (``_``) are left out."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no log at {path}")
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def _filesystem(path: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else pafs.LocalFileSystem()


def _ranges(path: str, start: int, size: int, block: int, open_end: bool) -> list[Range]:
    return [Range(path, at, min(at + block, size), size, open_end) for at in range(start, size, block)]


def _lines(fs: pafs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line) of a range: from the first line that begins in it to the end of the last one."""
    with fs.open_input_file(part.path) as f:
        at = part.start
        if at:  # a line that began before it belongs to the range before
            at -= 1
            f.seek(at)
            while True:
                piece = f.read(min(_CHUNK, part.size - at))
                if not piece:
                    return
                n = piece.find(b"\n")
                at += len(piece) if n < 0 else n + 1
                if n >= 0:
                    break
        f.seek(at)
        rest, begin = b"", at
        while begin < part.end:
            piece = f.read(min(_CHUNK, part.size - begin - len(rest)))
            if not piece:
                if rest and part.open_end:
                    yield begin, rest
                return
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                if begin >= part.end:
                    return
                yield begin, line
                begin += len(line) + 1


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.block = options["path"], int(options.get("blockbytes", options.get("blockBytes", BLOCK_BYTES)))

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        name = part.path.rsplit("/", 1)[-1]
        for position, line in _lines(_filesystem(self.path), part):
            yield name, position, line.decode("utf-8", "replace")


class _BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, size in _files(self.path) for r in _ranges(path, 0, size, self.block, True)]


class _StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are sizes by file, up to the last newline."""

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        fs = _filesystem(self.path)
        return {"sizes": json.dumps({path: self._complete(fs, path, size) for path, size in _files(self.path)}, sort_keys=True)}

    @staticmethod
    def _complete(fs: pafs.FileSystem, path: str, size: int) -> int:
        """How many bytes there are up to the last newline, looked for from the end."""
        with fs.open_input_file(path) as f:
            while size:
                begin = max(0, size - _CHUNK)
                f.seek(begin)
                n = f.read(size - begin).rfind(b"\n")
                if n >= 0:
                    return begin + n + 1
                size = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, new = json.loads(start["sizes"]), json.loads(end["sizes"])
        return [r for path, size in sorted(new.items()) for r in _ranges(path, old.get(path, 0), size, self.block, False)]

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, position long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and the package to its tasks."""
    from lorekeep.sources.shipping import ship_package

    ship_package(spark)
    spark.dataSource.register(EventLog)
