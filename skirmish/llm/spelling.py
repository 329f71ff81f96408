"""Spelling variant grouping: words one letter apart, found in a trie of letter counts.

Words are the maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of
whole texts, with only A-Z lower-cased; ``words`` also makes the slips of the
contract. Those of at least ``LEAST`` letters seen at least ``SEEN`` times
are grouped. Two words are near if one inserted, deleted or replaced letter turns
one into the other. A word's form is its near word of largest count (ties: the
least word), if that is ``TIMES`` times as frequent; its root is where the chain
of forms ends.

Method. A word's vector is its length and then how often each letter group occurs
in it. The vectors form a trie, one group per level. One edit moves at most one
count up and one down, so a depth-first search with a budget of one surplus and
one deficit finds all near words; the words at the leaves it reaches are compared
letter by letter. The edit can be read in either direction, so a search only goes to
the longer word, or for words of one length to the larger vector: its first step
aside is a surplus.

The trie is cut into subtrees of at most ``SUBTREE`` words. Counts of prefixes, level
by level, give the inner nodes that are too large for one task; a word goes home to
the first prefix that is small enough, and as a visitor to every other such prefix
that its budget reaches. Each pair meets in exactly one subtree. Inside, the search
runs level by level over sorted arrays, for blocks of words. A leaf that is too large
itself (words of one vector) is dealt to slices, and every visitor goes to all of them.

What the driver holds: inner nodes and their children, about one per SUBTREE words
and level. Tasks return one row per word (how many near words, the best), not pairs.

Null and empty texts hold no words. A null doc_id counts as an empty one in the hash.
Repeated rows count as often as they occur. Very long words are compared as they are.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.session import cut

LEAST = 7
SEEN = 2
TIMES = 10
SLIP = 31
# Words of a subtree, which one task holds.
SUBTREE = 16_384
# Words searched at once, and pairs compared at once.
BLOCK = 2_048
PAIRS = 1 << 18
# Letters of the array comparison; longer words are compared one by one.
WIDE = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Levels of the trie: length, each plain letter (frequent ones first, they divide best), eight groups of other letters.
_ORDER = "eationrshldcumfpgwybvkxjqz"
LEVELS = 1 + len(_ORDER) + 8
_LEVEL = np.zeros(256, np.int64)
_LEVEL[np.frombuffer(_ORDER.encode(), np.uint8)] = 1 + np.arange(len(_ORDER))
_LEVEL[0xC0:] = 1 + len(_ORDER) + np.arange(64) // 8


def words(docs: DataFrame, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(word, n): the words of all texts with their slips, and how often they occur."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
        F.explode(
            F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
        ).alias("_run"),
    )
    runs = runs.select("_doc", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    slipped = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    word = F.when(F.col("_h") % SLIP == 0, slipped).otherwise(F.col("_run"))
    counts = hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= seen)


def vectors(found: list[str]) -> np.ndarray:
    """Length and letter-group counts, one row per word."""
    raw = np.frombuffer("".join(found).encode("latin-1"), np.uint8)
    length = np.fromiter(map(len, found), np.int64, len(found))
    cell = np.repeat(np.arange(len(found)) * LEVELS, length) + _LEVEL[raw]
    counts = np.bincount(cell, minlength=len(found) * LEVELS).reshape(-1, LEVELS)
    counts[:, 0] = length
    return counts


class Frontier(NamedTuple):
    """Searches under way: word, trie node, whether each step is spent, and at which level.

    ``up`` and ``down`` are the level of the step, LEVELS while it is left, -1 where there is none.
    """

    word: np.ndarray
    node: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def take(self, at: np.ndarray) -> Frontier:
        return Frontier(*(x[at] for x in self))


def _steps(now: Frontier, counts: np.ndarray, level: int) -> Iterator[tuple[Frontier, np.ndarray]]:
    """Every way one level down that the budget allows: searches and the count they ask for."""
    value = counts[now.word, level]
    yield now, value
    if level == 0:
        # one letter more: a surplus to come and no deficit
        yield now._replace(down=np.full(len(value), -1)), value + 1
        return
    at = np.flatnonzero(now.up == LEVELS)
    if len(at):
        part = now.take(at)
        yield part._replace(up=np.full(len(at), level)), value[at] + 1
    at = np.flatnonzero((now.up < LEVELS) & (now.down == LEVELS) & (value > 0))
    if len(at):
        part = now.take(at)
        yield part._replace(down=np.full(len(at), level)), value[at] - 1


def _start(found: np.ndarray) -> Frontier:
    n = len(found)
    return Frontier(found, np.zeros(n, np.int64), np.full(n, LEVELS), np.full(n, LEVELS))


def _joined(parts: list[Frontier]) -> Frontier:
    return Frontier(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted keys are there, and their positions."""
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    there = np.flatnonzero(keys[at] == wanted)
    return there, at[there]


# --- cutting the trie ------------------------------------------------------------------------


class Top(NamedTuple):
    """The trie above the subtrees.

    Per level: sorted keys (node * span + count) of the children of inner nodes, the id of a child
    that is inner itself (else -1), and its number of slices if it is a crowded leaf.
    """

    span: int
    keys: list[np.ndarray]
    inner: list[np.ndarray]
    slices: list[np.ndarray]


def _places(top: Top, counts: np.ndarray, start: Frontier, own: bool) -> Iterator[tuple[Frontier, np.ndarray, np.ndarray]]:
    """Subtrees that words reach: (searches, number of the subtree, its slices)."""
    now, before = start, 0
    for level, keys in enumerate(top.keys):
        going = []
        for part, value in [(now, counts[now.word, level])] if own else _steps(now, counts, level):
            there, at = _find(keys, part.node * top.span + value)
            part, inner = part.take(there), top.inner[level][at]
            leaf = inner < 0
            yield part.take(leaf), before + at[leaf], top.slices[level][at[leaf]]
            going.append(part.take(~leaf)._replace(node=inner[~leaf]))
        now, before = _joined(going), before + len(keys)
        if not len(now.word):
            return


def _prefix_counts(batches: Iterator[pa.RecordBatch], top: Top) -> Iterator[pa.RecordBatch]:
    """(key, words) of the level below the last one known, for the words under inner nodes."""
    level = len(top.keys)
    for batch in batches:
        if not len(batch):
            continue
        counts = vectors(batch.column("word").to_pylist())
        node = np.zeros(len(counts), np.int64)
        under = np.arange(len(counts))
        for depth in range(level):
            there, at = _find(top.keys[depth], node[under] * top.span + counts[under, depth])
            under, inner = under[there], top.inner[depth][at]
            under, inner = under[inner >= 0], inner[inner >= 0]
            node[under] = inner
        keys, number = np.unique(node[under] * top.span + counts[under, level], return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": keys, "words": number})


def cut_trie(vocabulary: DataFrame, subtree: int = SUBTREE) -> Top | None:
    """The trie down to prefixes of at most ``subtree`` words; None if there is no word."""
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return None
    top = Top(longest + 3, [], [], [])
    for level in range(LEVELS):
        known = top
        parts = vocabulary.select("word").mapInArrow(lambda b, t=known: _prefix_counts(b, t), "key long, words long")
        rows = parts.groupBy("key").agg(F.sum("words").alias("words")).orderBy("key").collect()
        keys = np.array([r.key for r in rows], np.int64)
        size = np.array([r.words for r in rows], np.int64)
        crowded = (size > subtree) & (level < LEVELS - 1)
        inner = np.where(crowded, np.cumsum(crowded) - 1, -1)
        slices = np.where(crowded, 1, -(-size // subtree))
        top = Top(top.span, [*top.keys, keys], [*top.inner, inner], [*top.slices, slices])
        if not crowded.any():
            break
    return top


def _send(batches: Iterator[pa.RecordBatch], top: Top) -> Iterator[pa.RecordBatch]:
    """Each word to its home subtree, and as a visitor to the others in its reach."""
    for whole in batches:
        for first in range(0, len(whole), BLOCK):
            batch = whole.slice(first, BLOCK)
            found = batch.column("word").to_pylist()
            counts = vectors(found)
            mark = np.fromiter((hash_of(w) for w in found), np.int64, len(found))
            out = []
            for own in (True, False):
                for part, tree, slices in _places(top, counts, _start(np.arange(len(found))), own):
                    straight = (part.up == LEVELS) & (part.down == LEVELS)
                    mine = mark[part.word] % slices
                    for k in range(int(slices.max(initial=0))):
                        # a word is at home in its own slice, and visits those after it
                        fits = (slices > k) & ((mine == k) if own else ~straight | (mine < k))
                        out.append((part.word[fits], tree[fits], np.full(fits.sum(), k), np.full(fits.sum(), own)))
            at, tree, part, home = (np.concatenate(x) for x in zip(*out, strict=True))
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_pydict(
                {"tree": tree, "part": part, "home": home, "word": picked.column("word"), "n": picked.column("n")}
            )


def hash_of(word: str) -> int:
    """A stable small hash; deals the words of a crowded leaf to slices."""
    value = 0
    for c in word[:WIDE]:
        value = (value * 31 + ord(c)) & 0x7FFFFFFF
    return value


# --- inside a subtree ------------------------------------------------------------------------


def _near_one(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced, or one more."""
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def verified(found: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are one letter apart; b is as long as a or one letter longer."""
    length = np.fromiter(map(len, found), np.int64, len(found))
    good = np.zeros(len(a), bool)
    long = length[b] >= WIDE
    for i in np.flatnonzero(long):
        good[i] = _near_one(found[a[i]], found[b[i]])
    short = np.flatnonzero(~long)
    if not len(short):
        return good
    table = np.array([w.encode("latin-1") if len(w) < WIDE else b"" for w in found], f"S{WIDE}")
    table = table.view(np.uint8).reshape(-1, WIDE)
    width = int(length[b[short]].max()) + 1
    for first in range(0, len(short), PAIRS):
        at = short[first : first + PAIRS]
        left, right = table[a[at], :width], table[b[at], :width]
        differ = left != right
        alike = length[a[at]] == length[b[at]]
        one = differ.sum(1) == 1
        tail = left[:, :-1] != right[:, 1:]
        last = np.where(tail.any(1), width - 2 - tail[:, ::-1].argmax(1), -1)
        good[at] = np.where(alike, one, last < differ.argmax(1))
    return good


class Trie:
    """Words by their vectors, one sorted array of (node, count) keys per level."""

    def __init__(self, counts: np.ndarray):
        self.span = int(counts.max()) + 3
        self.keys = []
        node = np.zeros(len(counts), np.int64)
        for level in range(LEVELS):
            keys, node = np.unique(node * self.span + counts[:, level], return_inverse=True)
            self.keys.append(keys)
        self.order = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.order], np.arange(len(self.keys[-1]) + 1))

    def search(self, counts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, home word) of every leaf word within the budget, from rows of ``counts``."""
        now = _start(found)
        for level, keys in enumerate(self.keys):
            parts = []
            for part, value in _steps(now, counts, level):
                # what the trie does not hold cannot be a key of another node
                there, at = _find(keys, part.node * self.span + np.minimum(value, self.span - 1))
                parts.append(part.take(there)._replace(node=at))
            now = _joined(parts)
        size = self.first[now.node + 1] - self.first[now.node]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(now.word, size), self.order[np.repeat(self.first[now.node], size) + inside]


def _search_subtree(rows: pa.Table) -> pa.Table:
    """How many near words each word met here, and the best of them."""
    rows = rows.sort_by([("home", "descending")])
    home = pc.sum(rows["home"]).as_py()
    found, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    near = np.zeros(len(found), np.int64)
    # the least rank is the best near word: largest count, then least word
    order = sorted(range(len(found)), key=lambda i: (-n[i], found[i]))
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    best = np.full(len(found), len(found))
    if home:
        counts = vectors(found)
        trie = Trie(counts[:home])
        for first in range(0, len(found), BLOCK):
            a, b = trie.search(counts, np.arange(first, min(first + BLOCK, len(found))))
            # words of one vector are met from both sides
            alike = (a >= home) | (a < b) | (counts[a] != counts[b]).any(1)
            a, b = a[alike & (a != b)], b[alike & (a != b)]
            good = verified(found, a, b)
            a, b = a[good], b[good]
            for x, y in ((a, b), (b, a)):
                near += np.bincount(x, minlength=len(found))
                np.minimum.at(best, x, rank[y])
    at = np.flatnonzero(near)
    form = [order[k] for k in best[at]]
    names = [pa.array([found[i] for i in x], pa.string()) for x in (at, form)]
    return pa.table({"word": names[0], "near": near[at], "form": names[1], "form_n": n[np.array(form, np.int64)]})


def near_words(vocabulary: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best, best_n) of each word of (word, n) that has near words."""
    top = cut_trie(vocabulary, subtree)
    spark = vocabulary.sparkSession
    if top is None:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    sent = vocabulary.select("word", "n").mapInArrow(
        lambda b: _send(b, top), "tree long, part long, home boolean, word string, n long"
    )
    met = sent.groupBy("tree", "part").applyInArrow(
        _search_subtree, "word string, near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("best")))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) where the chain of (word, form) ends; the number of steps doubles each round.

    Counts grow tenfold along a chain, so chains are short and have no rings.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = now.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        step = cut(step)
        now = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return now


def variants(docs: DataFrame, times: int = TIMES, subtree: int = SUBTREE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    vocabulary = cut(words(docs))
    found = near_words(vocabulary, subtree)
    joined = vocabulary.join(found, "word", "left")
    enough = F.col("best_n") >= times * F.col("n")
    table = cut(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best")).alias("form"),
            F.when(enough, F.col("best_n")).alias("form_n"),
        )
    )
    chain = roots(table.where("form IS NOT NULL"))
    return table.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
