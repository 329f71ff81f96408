"""Benchmark decontamination by question templates.

Words stand between ASCII white space, lose punctuation at both ends and their
case. Numbers become ``<num>``, units ``<unit>``, capitalised words inside a
sentence ``<name>``; what a placeholder stands for is kept as its slot. Windows
of eight such tokens (of all, for shorter items) of the benchmark are matched
by hash with the windows of every document. The first word of an item opens a
sentence there, but may follow other words in a document: with a capital, its
window is looked for under both readings, as a word and as ``<name>``, and the
word itself must be the same. Windows with less than half of plain words say
too little as templates and are left out; an item that has no others is looked
for by its literal words, in windows of the same width, without placeholders.
Matched windows of one item on one alignment are then walked in order: plain
words must be equal, and all that a slot value of the item stands for must be
one value in the document and no other slot's value of its type, or the window
does not count.
An item is found if the windows that count are at least ``SHARE`` of its
windows. Changed slots mark a re-parameterised question.

The windows of the benchmark are sent to the tasks in parts of bounded size
(``PART_BYTES`` of item text each); one part is the usual case and costs no
shuffle. Null texts and texts or items without words match nothing. Items with
null ids are skipped. Repeated rows get the same answer each; an item_id that
occurs twice counts as two questions of one name. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import chunks, hashes, windows, words

WIDTH, SHARE = 8, 0.4
PART_BYTES = 16 << 20
WORD, NUMBER, UNIT, NAME = range(4)
_EDGE = "!?.,;:\"'()[]{}<>|*#&_-=/\\~`"
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*%?")
_NAMED = hashes(["<name>"])[0]
_UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs ms hz w kw kwh v a pa bar k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds "
    "minute minutes hour hours day days week weeks month months year years dollar dollars euro euros "
    "cent cents percent degree degrees".split()
)


def _kinds(vocabulary: list[str]):
    """Of each word: kind, hash of its token, bare form, whether capital, whether it ends a sentence."""
    bare, kind, capital, ends = [], [], [], []
    for word in vocabulary:
        b = word.strip(_EDGE)
        low = b.lower()
        bare.append(low)
        kind.append(NUMBER if _NUMBER.fullmatch(b) else UNIT if low in _UNITS else WORD)
        capital.append(b[:1].isupper() and not b.isupper())
        ends.append(word.rstrip("\"')]}")[-1:] in (".", "!", "?", ":"))
    token = [("<num>", "<unit>")[k - 1] if k else b for b, k in zip(bare, kind, strict=True)]
    return np.array(kind, np.int8), hashes(token), bare, np.array(capital, bool), np.array(ends, bool)


def _tokens(texts: pa.Array):
    """(token hashes, kinds, whether capital, words per text, codes, bare forms)."""
    codes, lengths, vocabulary = words(texts)
    kind, hashed, bare, capital, ends = _kinds(vocabulary)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), lengths, codes, bare
    first = np.zeros(len(codes), bool)
    starts = np.cumsum(lengths) - lengths
    first[starts[lengths > 0]] = True
    opens = np.concatenate([[True], ends[codes[:-1]]]) | first
    kinds = kind[codes]
    name = capital[codes] & ~opens & (kinds == WORD)
    kinds[name] = NAME
    return np.where(name, _NAMED, hashed[codes]), kinds, capital[codes], lengths, codes, bare


def template_windows(items: list[tuple[int, str]]):
    """Windows of the benchmark: for each width, templates and literal words apart, sorted
    hashes with (item row, position) of each; and the items."""
    hashed, kinds, capital, lengths, codes, bare = _tokens(pa.array([t for _, t in items], pa.string()))
    starts = np.cumsum(lengths) - lengths
    entries, sizes = [], np.zeros(len(items), np.int64)
    widths = np.minimum(lengths, WIDTH)
    plain = np.concatenate([[0], np.cumsum(kinds == WORD)])
    first = np.zeros(len(codes), bool)
    first[starts[lengths > 0]] = True
    named = np.where(first & capital & (kinds == WORD), _NAMED, hashed)
    for width in sorted({int(w) for w in widths if w > 0}):
        value, owner, at = windows(hashed, lengths, width, whole_if_shorter=False)
        begin = starts[owner] + at
        good = (widths[owner] == width) & (2 * (plain[begin + width] - plain[begin]) >= width)
        np.add.at(sizes, owner[good], 1)
        other = windows(named, lengths, width, whole_if_shorter=False)[0]
        both = good & (other != value)
        entries.append(
            (
                width,
                False,
                np.concatenate([value[good], other[both]]),
                np.concatenate([owner[good], owner[both]]),
                np.concatenate([at[good], at[both]]),
            )
        )
    # items that no template tells apart
    mute = sizes == 0
    literal = hashes(bare)[codes]
    for width in sorted({int(w) for w in widths[mute] if w > 0}):
        value, owner, at = windows(literal, lengths, width, whole_if_shorter=False)
        good = (widths[owner] == width) & mute[owner]
        np.add.at(sizes, owner[good], 1)
        entries.append((width, True, value[good], owner[good], at[good]))
    content = [
        [(int(k), bare[c]) for k, c in zip(kinds[s : s + n], codes[s : s + n], strict=True)]
        for s, n in zip(starts, lengths, strict=True)
    ]
    index = []
    for width, literal, value, owner, at in entries:
        if len(value):
            order = np.argsort(value, kind="stable")
            index.append((width, literal, value[order], owner[order], at[order]))
    return index, sizes, content, [i for i, _ in items]


def _found(matches, sizes, content, names, tokens) -> dict[int, bool]:
    """Items found in one document: item_id to whether slots were changed."""
    lines = defaultdict(set)
    for row, item_at, doc_at, width in matches:
        lines[row, doc_at - item_at].add((item_at, width))
    covered, changed = defaultdict(set), defaultdict(bool)
    for (row, shift), windows_ in lines.items():
        there: dict = {}
        back: dict = {}
        for item_at, width in sorted(windows_):
            new, fits = {}, True
            for k in range(item_at, item_at + width):
                kind, value = content[row][k]
                given = tokens[shift + k]
                if kind == WORD:
                    if given != value:
                        fits = False
                        break
                    continue
                known = new.get((kind, value), there.get((kind, value)))
                owner = back.get((kind, given), value)
                if (known is not None and known != given) or owner != value:
                    fits = False
                    break
                new[kind, value] = given
            if not fits:
                continue
            there.update(new)
            back.update({(kind, given): value for (kind, value), given in new.items()})
            covered[row].add(item_at)
            changed[row] |= any(value != given for (_, value), given in new.items())
    found: dict[int, bool] = {}
    for row, at in covered.items():
        if len(at) >= SHARE * sizes[row]:
            found[names[row]] = found.get(names[row], False) or changed[row]
    return found


def _search(index, sizes, content, names):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bitmap lets nearly all windows of a document pass without a search
        maps = []
        for _, _, value, _, _ in index:
            seen = np.zeros(1 << 22, bool)
            seen[value >> np.uint64(42)] = True
            maps.append(seen)
        for batch in batches:
            for part in chunks(batch):
                hashed, _, _, lengths, codes, bare = _tokens(part.column("text"))
                exact = hashes(bare)[codes] if any(literal for _, literal, *_ in index) else None
                starts = np.cumsum(lengths) - lengths
                hits = defaultdict(list)
                for (width, literal, value, owner, at), seen in zip(index, maps, strict=True):
                    run, text, place = windows(exact if literal else hashed, lengths, width, whole_if_shorter=False)
                    some = seen[run >> np.uint64(42)]
                    run, text, place = run[some], text[some], place[some]
                    lo, hi = np.searchsorted(value, run, "left"), np.searchsorted(value, run, "right")
                    for i in np.flatnonzero(hi > lo):
                        for j in range(lo[i], hi[i]):
                            hits[int(text[i])].append((int(owner[j]), int(at[j]), int(place[i]), width))
                items, changed = [None] * part.num_rows, [None] * part.num_rows
                for i in range(part.num_rows):
                    found: dict[int, bool] = {}
                    if i in hits:
                        own = [bare[c] for c in codes[starts[i] : starts[i] + lengths[i]]]
                        found = _found(hits[i], sizes, content, names, own)
                    items[i] = sorted(found)
                    changed[i] = sorted(k for k, v in found.items() if v)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(items, pa.list_(pa.int64())),
                        pa.array(changed, pa.list_(pa.int64())),
                    ],
                    ["row", "items", "changed"],
                )

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (struct of the kept columns, doc_id by default), items, changed of each document.

    items: ids found, ascending; changed: those of them with other slot values.
    """
    keep = keep or ["doc_id"]
    asked = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    volume = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(volume) // PART_BYTES))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    schema = rows.select("row").schema
    for name in ("items", "changed"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    if parts == 1:
        found = sorted(map(tuple, asked.collect()))
        return rows.mapInArrow(_search(*template_windows(found)), schema)
    # a large benchmark: one pass for each part, answers put together by text
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    hits = []
    for part in range(parts):
        found = sorted(map(tuple, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()))
        hits.append(
            keyed.mapInArrow(
                _search(*template_windows(found)), "row long, items array<bigint>, changed array<bigint>"
            ).where(F.size("items") > 0)
        )
    merged = (
        reduce(DataFrame.unionByName, hits)
        .distinct()
        .groupBy("row")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("changed")))).alias("changed"),
        )
        .withColumnRenamed("row", "_text")
    )
    none = F.array().cast("array<bigint>")
    return (
        rows.withColumn("_text", F.xxhash64("text"))
        .join(merged, "_text", "left")
        .select("row", F.coalesce("items", none).alias("items"), F.coalesce("changed", none).alias("changed"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, changed_ids (comma-joined) of every document."""
    return leaks(docs, benchmark).select(
        "row.doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.array_join("items", ",").alias("item_ids"),
        F.array_join("changed", ",").alias("changed_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark item, with all their columns."""
    return leaks(docs, benchmark, docs.columns).where(F.size("items") == 0).select("row.*")
