"""Token counts of the parts of documents, from one encoding of the whole text.

A text is encoded once, as a whole, so that no merge is lost at the border of a
part. The byte lengths of its tokens give each token's span of characters (a
token that holds only some bytes of a character spans that character). Token
spans and section spans are both in order, so the interval join is two binary
searches a section inside the task that holds the text; sections may overlap or
leave gaps.

Rules for tokens that cross a border: ``first`` gives a token to the section
that holds its first character, ``last`` to that of its last character,
``share`` in parts by characters. With sections that tile the text, counts sum
up to the document's under every rule (tokens that split a character go with
it under ``share``).

Sections are the lines of the text by default (each with its line end), or come
as an array of (name, start, end) in code points, end exclusive; null bounds and
sections without characters hold no tokens. Null texts count as empty: one empty
line without tokens. Repeated rows are counted each. Extra columns are ignored.
The tokenizer is a rank file (``path``) read on the driver and sent to the
tasks; it is about a megabyte and does not grow with the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import chunks

RULES = ("first", "last", "share")
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank`` in any store."""
    found = {}
    for row in spark.read.text(path).collect():
        if row.value:
            token, rank = row.value.split()
            found[base64.b64decode(token)] = int(rank)
    return found


def spans(text: str, encoder, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character of each token, end of its last one, and the text's bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths[np.array(encoder.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1, data


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its line end; a text has one line at least."""
    character = np.cumsum((data & 0xC0) != 0x80)
    total = int(character[-1]) if len(data) else 0
    cuts = character[data == 10]
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [total]])
    if len(starts) > 1 and starts[-1] == total:  # nothing after the last line end
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def allot(
    first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many of its tokens cross its borders."""
    from_, to = np.searchsorted(first, starts, "left"), np.searchsorted(first, ends, "left")
    reach = np.searchsorted(end, starts, "right")  # first token that ends inside or beyond
    overlap = np.maximum(to - reach, 0)
    whole = np.maximum(np.searchsorted(end, ends, "right") - from_, 0)
    some = ends > starts
    crossing = np.where(some, overlap - whole, 0)
    if rule == "first":
        count = to - from_
    elif rule == "last":
        count = np.searchsorted(end, ends, "right") - reach
    else:
        count = whole.astype(float)
        for i in np.flatnonzero(crossing > 0):
            for k in (k for k in range(reach[i], to[i]) if first[k] < starts[i] or end[k] > ends[i]):
                inside = min(end[k], ends[i]) - max(first[k], starts[i])
                count[i] += inside / (end[k] - first[k])
    return np.where(some, np.maximum(count, 0), 0), crossing


def token_counts(
    docs: DataFrame,
    sections: Column | None = None,
    path: str = RANKS,
    pattern: str = PATTERN,
    rule: str = "first",
) -> DataFrame:
    """doc_id, section, name, start, end, tokens, crossing, doc_tokens: a row per section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((read_ranks(spark, path), pattern))
    given = sections is not None
    inside = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *([F.coalesce(sections, F.array()).alias("sections")] if given else []),
    )
    kinds = {
        "doc_id": pa.int64(), "section": pa.int32(), "name": pa.string(), "start": pa.int64(), "end": pa.int64(),
        "tokens": pa.float64() if rule == "share" else pa.int64(), "crossing": pa.int64(), "doc_tokens": pa.int64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, split = sent.value
        encoder = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        widths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            widths[rank] = len(token)
        for batch in batches:
            for part in chunks(batch):
                columns: dict[str, list] = {k: [] for k in kinds}
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                known = np.asarray(part.column("doc_id").is_valid())
                parts = part.column("sections").to_pylist() if given else [None] * part.num_rows
                for k, text in enumerate(part.column("text").to_pylist()):
                    first, end, data = spans(text, encoder, widths)
                    names = None
                    if given:
                        rows = parts[k] or []
                        names = [r and r["name"] for r in rows]
                        bounds = [
                            (r["start"], r["end"]) if r and r["start"] is not None and r["end"] is not None else (0, 0)
                            for r in rows
                        ]
                        starts, ends = np.array(bounds, np.int64).reshape(-1, 2).T
                    else:
                        starts, ends = line_spans(data)
                    tokens, crossing = allot(first, end, starts, ends, rule)
                    n = len(starts)
                    columns["doc_id"].append(np.full(n, int(ids[k]) if known[k] else -1))
                    columns["section"].append(np.arange(n))
                    columns["name"] += names or [None] * n
                    columns["start"].append(starts)
                    columns["end"].append(ends)
                    columns["tokens"].append(tokens)
                    columns["crossing"].append(crossing)
                    columns["doc_tokens"].append(np.full(n, len(first)))
                null = np.repeat(~known, [len(x) for x in columns["section"]])
                arrays = [
                    pa.array(columns[c], kind)
                    if c == "name"
                    else pa.array(np.concatenate(columns[c]), mask=null if c == "doc_id" else None).cast(kind)
                    for c, kind in kinds.items()
                ]
                yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    count = "double" if rule == "share" else "long"
    return inside.mapInArrow(
        run,
        f"doc_id long, section int, name string, start long, end long, tokens {count}, crossing long, doc_tokens long",
    )
