"""Following log files that grow: a streaming source with a byte offset per file.

Logs lie as ``<path>/<log_id>/<name>.txt``. A micro-batch holds the bytes of each
file from the last offset to the end of its last complete line, so a half-written
line waits until its end arrives. A line's seq is its file's number within the log and its
first byte; it is the same on every retry, and the same bytes can be read again
by seq (``read_span``), so lines need no copy.

Large files are read in splits of ``split_bytes``. A micro-batch takes at most about
``max_bytes`` of each file, so that a first catch-up goes in steps.

A file that shrinks is not read again until it is larger than before. Files found
later are numbered after those known, among each other by the time in their name.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "log_id string, seq bigint, value string"
# Bits of a line's first byte; a file has at most 2**44 bytes.
OFFSET_BITS = 44
MAX_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _begun(name: str) -> tuple:
    """Files of a log in order: by the time in their name, then by name."""
    stamp = re.fullmatch(r"[^-]*-(\d{6}_\d{6})\.txt", name)
    try:
        return (datetime.strptime(stamp[1], "%m%d%y_%H%M%S").timestamp() if stamp else 0, name)
    except ValueError:
        return (0, name)


def log_files(path: str) -> dict[str, int]:
    """Size of every log file below the path, by "<log_id>/<name>"."""
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = {}
    for f in found:
        parts = posixpath.relpath(f.path, root).split("/")
        if f.type == fs.FileType.File and len(parts) == 2 and f.path.endswith(".txt"):
            files["/".join(parts)] = f.size
    return files


def _whole_lines(store: fs.FileSystem, path: str, low: int, high: int, size: int) -> int:
    """End of the last complete line in [low, high); of the first one beyond it if there is none."""
    with store.open_input_file(path) as f:
        end = high
        while end > low:
            begin = max(low, end - _BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        f.seek(high)
        while high < size:
            block = f.read(min(_BLOCK, size - high))
            if not block:
                break
            at = block.find(b"\n")
            if at >= 0:
                return high + at + 1
            high += len(block)
    return low


def positions(path: str) -> dict[str, list[int]]:
    """[number, end of the last complete line] of every file as it stands."""
    return _advance(path, {}, None)


def _advance(path: str, known: dict, max_bytes: int | None) -> dict:
    store, root = _open(path)
    ends = {name: list(v) for name, v in known.items()}
    numbers: dict[str, int] = {}
    for name, (number, _) in ends.items():
        log = name.split("/")[0]
        numbers[log] = max(numbers.get(log, -1), number)
    for name, size in sorted(log_files(path).items(), key=lambda x: (x[0].split("/")[0], _begun(x[0].split("/")[1]))):
        log = name.split("/")[0]
        if name not in ends:
            numbers[log] = numbers.get(log, -1) + 1
            ends[name] = [numbers[log], 0]
        low = ends[name][1]
        if size > low:
            high = size if max_bytes is None else min(size, low + max_bytes)
            ends[name][1] = _whole_lines(store, posixpath.join(root, name), low, high, size)
    return ends


class Span(InputPartition):
    """Lines of one file that begin in [low, high); ``first`` is where a line is known to begin."""

    def __init__(self, path: str, name: str, number: int, first: int, low: int, high: int):
        self.path, self.name, self.number, self.first, self.low, self.high = path, name, number, first, low, high


def _spans(path: str, name: str, number: int, low: int, high: int, split: int) -> Iterator[Span]:
    for at in range(low, high, split):
        yield Span(path, name, number, low, at, min(at + split, high))


def _lines(part: Span) -> Iterator[pa.RecordBatch]:
    store, root = _open(part.path)
    log, shift = part.name.split("/")[0], part.number << OFFSET_BITS
    with store.open_input_file(posixpath.join(root, part.name)) as f:
        # A split begins with the first line that begins in it.
        at = part.low if part.low == part.first else part.low - 1
        f.seek(at)
        skip, rest = at != part.low, b""
        while True:
            block = f.read(_BLOCK)
            data = rest + block
            seqs, values, begin = [], [], 0
            while True:
                end = data.find(b"\n", begin)
                if end < 0 or at + begin >= part.high:
                    break
                if skip:
                    skip = False
                else:
                    seqs.append(shift + at + begin)
                    values.append(data[begin:end].rstrip(b"\r").decode("utf-8", "replace"))
                begin = end + 1
            if seqs:
                yield pa.RecordBatch.from_pydict(
                    {"log_id": pa.array([log] * len(seqs)), "seq": pa.array(seqs, pa.int64()), "value": pa.array(values)}
                )
            at, rest = at + begin, data[begin:]
            if not block or at >= part.high:
                return


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.begin = json.loads(options.get("begin", "{}"))
        # Offsets up to which lines were handed out; unknown after a restart.
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = self.begin
        return self.begin

    def latestOffset(self) -> dict:
        # Spark works off what it was told before it asks again.
        self.at = _advance(self.path, self.at or self.begin, None if self.at is None else self.max_bytes)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        parts = []
        for name, (number, high) in end.items():
            low = start.get(name, [number, 0])[1]
            parts.extend(_spans(self.path, name, number, low, high, self.split))
        return parts

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _lines(partition)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.spans = json.loads(options["spans"])
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Span]:
        return [s for name, number, low, high in self.spans for s in _spans(self.path, name, number, low, high, self.split)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _lines(partition)


class LogTail(DataSource):
    """Format ``log_tail``: streaming by offsets, batch by given spans."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)


def tail_logs(
    spark: SparkSession,
    path: str,
    begin: dict | None = None,
    max_bytes: int = MAX_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """A stream of lines(log_id, seq, value); from ``begin`` (see ``positions``) on, or all."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("max_bytes", max_bytes).option("split_bytes", split_bytes)
    return reader.option("begin", json.dumps(begin or {})).load(path)


def read_span(spark: SparkSession, path: str, spans: list[tuple[str, int, int, int]]) -> DataFrame:
    """Lines that begin in [low, high) of each (name, number, low, high), a line's start being at low."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("spans", json.dumps(spans)).load(path)
