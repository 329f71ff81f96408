"""Web archives with a two-level capture index.

Writing: each page becomes a WARC/1.1 record in a gzip member of its own. Of
pages with equal payloads (the html in UTF-8; null counts as empty) that with
the largest page_id is a ``response``; the others are ``revisit`` records,
which hold the HTTP header but not the payload and refer to the response.
Members are put together to archives of about ``ARCHIVE_BYTES``; one archive is
one row, cast to text and written by Spark's text writer, so any store that
Spark writes to will do. A zero byte pads the end of each file.

Index: the archives are read once and each capture gives a line ``key page_id
file offset length``. The key is the URL with its host reversed, so that
captures of a site are neighbours. Lines are sorted by range, cut into
compressed blocks of ``LINES``; the directory knows the first key of each block
only, and a list of at most ``PARTS`` first keys knows the ranges.

Reading: an asked key finds its range and then its block by binary search in
the directory, the line by binary search in that block, and the record by a
range read from the archive.

Rows without page_id count as smaller than all others and are named ``null``;
if no row of a payload has a page_id, all its rows are responses, and so are
all rows that repeat the largest page_id. Null URLs count as empty. Blanks and
line ends in URLs are written as %20, %09, %0D, %0A. An empty table gives no
archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.session import cut, shared_folder

ARCHIVE_BYTES = 8 << 20
LINES, PARTS = 3000, 1 << 17
CAPTURES_PER_PART = 10_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(value: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits are four digits of base 32."""
    code = F.sha1(value)
    digits = [F.lpad(F.conv(F.substring(code, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), *_BASE32)


def plain_url(url: Column) -> Column:
    """The URL as it stands in a record."""
    out = F.coalesce(url, F.lit(""))
    for mark, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def capture_key(url: Column) -> Column:
    """Sort key: host labels reversed, then path and query, without scheme, port and fragment."""
    parts = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:www\\.)?([^/:?#]*)(?::\\d*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    return F.concat(
        F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2)
    )


def record(page_id, url: str, digest: str, size: int, payload: bytes | None, refers_to=None) -> bytes:
    """One WARC record; without a payload it is a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{name}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (payload or b"") + b"\r\n\r\n"


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    members: list[bytes] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            payload = None if row["refers_to"] is not None else row["payload"]
            text = record(row["page_id"], row["url"], row["digest"], row["size"], payload, row["refers_to"])
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            members.append(packer.compress(text) + packer.flush())
            size += len(members[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])
                members, size = [], 0
    if members:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for every page (page_id, url, html) into archives below ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        plain_url(F.col("url")).alias("url"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    # which page holds a payload is settled on ids and digests alone
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("kept"))
    revisits = (
        rows.select("page_id", "digest")
        .distinct()
        .join(largest, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("kept")))
        .select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("name"), "digest", F.col("kept").alias("refers_to"))
    )
    named = rows.withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    whole = named.join(revisits, ["name", "digest"], "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to"
    )
    (
        whole.mapInArrow(_archives, "content binary")
        .select(F.col("content").cast("string"))
        .write.option("lineSep", "\x00")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member."""
    at = 0
    while at < len(content) and content[at] != 0:
        reader, parts, read = zlib.decompressobj(31), [], at
        while not reader.eof:
            piece = content[read : read + 16384]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(reader.decompress(piece))
            read += len(piece)
        end = read - len(reader.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(text: bytes) -> dict:
    """Fields of a record; the digest of a response is taken from its payload."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        found = b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or size != len(payload):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": None if page == "null" else int(page),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers and int(refers[len("<urn:page:") : -1]),
        "payload": payload if kind == "response" else None,
    }


def captures(spark: SparkSession, path: str) -> DataFrame:
    """url, page_id, file, offset, length of every record in the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for offset, length, text in _members(memoryview(content.as_buffer())):
                    head = text[: text.index(b"\r\n\r\n")].decode()
                    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
                    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                    out.append((fields["WARC-Target-URI"], None if page == "null" else int(page), file, offset, length))
                columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["url", "page_id", "file", "offset", "length"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "url string, page_id long, file string, offset long, length long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of sorted lines: part, number, first, data."""
    lines: list[str] = []
    state = {"part": None, "number": 0, "first": None}

    def block():
        data = zlib.compress("\n".join(lines).encode(), 6)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([state["part"]], pa.int32()),
                pa.array([state["number"]], pa.int32()),
                pa.array([state["first"]], pa.string()),
                pa.array([data], pa.binary()),
            ],
            ["part", "number", "first", "data"],
        )
        state["number"] += 1
        lines.clear()
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if lines and (row["part"] != state["part"] or len(lines) >= LINES):
                yield block()
            state["part"] = row["part"]
            if not lines:
                state["first"] = row["key"]
            lines.append("\t".join(str(row[c]) for c in ("key", "page_id", "file", "offset", "length")))
    if lines:
        yield block()


def build_index(found: DataFrame, path: str) -> None:
    """Write the index of captures: ``blocks`` sorted by key in ``part`` folders."""
    keyed = found.select(
        F.regexp_replace(capture_key(F.col("url")), "[\\x00-\\x1f]", "").alias("key"), "page_id", "file", "offset", "length"
    )
    parts = min(PARTS, max(1, -(-found.count() // CAPTURES_PER_PART)))
    ordered = (
        keyed.repartitionByRange(parts, "key", "page_id")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("key", F.col("page_id").cast("string"))
    )
    ordered.mapInArrow(_blocks, "part int, number int, first string, data binary").write.parquet(path)


def _located(keys, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Captures of the asked keys in one part of the index."""
    out = []
    if len(asked) and len(blocks):
        blocks = blocks.sort_values(["number"], kind="stable")
        directory, data = blocks["first"].tolist(), blocks["data"].tolist()
        opened: dict[int, list[list[str]]] = {}
        for key in asked["key"].drop_duplicates().sort_values():
            # a key may start in the block before the first that begins with it
            at = max(0, bisect.bisect_left(directory, key) - 1)
            while at < len(directory) and directory[at] <= key:
                if at not in opened:
                    opened.clear()
                    opened[at] = [x.split("\t") for x in zlib.decompress(data[at]).decode().split("\n")]
                lines = opened[at]
                line = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while line < len(lines) and lines[line][0] == key:
                    out.append(lines[line])
                    line += 1
                at += 1
    frame = pd.DataFrame(out, columns=["key", "page", "file", "offset", "length"])
    return frame.astype({"offset": "int64", "length": "int64"})


def lookup(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """file, offset, length of the captures of the asked urls (column ``url``)."""
    blocks = spark.read.parquet(index)
    # first keys of the parts: at most PARTS strings
    starts = sorted((r["first"], r["part"]) for r in blocks.groupBy("part").agg(F.min("first").alias("first")).collect())
    asked = urls.select(
        F.regexp_replace(capture_key(plain_url(F.col("url"))), "[\\x00-\\x1f]", "").alias("key")
    ).distinct()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, names = [x for x, _ in starts], [n for _, n in starts]
        for batch in batches:
            keys, parts = [], []
            for key in batch.column("key").to_pylist():
                last = bisect.bisect_right(firsts, key) - 1
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                for k in range(at, max(at, last) + 1):  # captures of one key may fill several parts
                    if names:
                        keys.append(key)
                        parts.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.int32())], ["key", "part"])

    placed = asked.mapInArrow(ranges, "key string, part int")
    return (
        placed.groupBy("part")
        .cogroup(blocks.groupBy("part"))
        .applyInPandas(_located, "key string, page string, file string, offset long, length long")
    )


def read_records(found: DataFrame) -> DataFrame:
    """Range reads: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    store, place = pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
                    source = store.open_input_file(place)
                text = zlib.decompress(source.read_at(row["length"], row["offset"]), 31)
                out.append(parse(text))
                size += len(text)
                if size > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names)
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names)

    near = found.repartition("file").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def archive(pages: DataFrame, home: str | None = None) -> DataFrame:
    """Write archives and index below ``home``, then read every page's record through the index."""
    spark = pages.sparkSession
    home = home or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{home}/archives")
    build_index(cut(captures(spark, f"{home}/archives")), f"{home}/index")
    return read_records(lookup(spark, f"{home}/index", pages.select("url")))
