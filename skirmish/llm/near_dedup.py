"""Near-duplicate documents with DartMinHash signatures.

A text is the set of its runs of five words (words stand between ASCII white
space; a shorter text is one run). Two texts are linked if the Jaccard
similarity of their sets is 0.8 or more; classes are the connected components.

Signatures throw darts: each element owns a hashed, unit-rate random scatter of
darts in a plane of weight by rank. A set sees the darts below its elements'
weights and below a rank bound that leaves a few darts per coordinate; every
dart falls on one of the signature's coordinates and the one of least rank
stays. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity, and a signature costs one pass over elements and darts
instead of one per coordinate. Weights are 1 by default (sets); with
``weighted`` a run weighs as often as it occurs.

32 bands of 5 coordinates miss a pair at exactly 0.8 with probability 3e-6.
Candidates come from shared bands and are all compared exactly:

* every text with up to three leaders of its buckets (the text with most bucket
  mates, two by hash), one after the other as long as they are not joined, which
  joins up a large group at the cost of about one comparison a member;
* then all texts that share a bucket but no component so far: as pairs in small
  buckets, in large ones block against block, where only links that join
  components come back.

Pairs inside one component are left out: no link between them can change a
class. Null texts count as empty; texts without words are linked only to equal
texts. Equal texts are one node, named by a 64-bit hash of the text, so groups
of copies cost nothing. class_id is the least doc_id of the class (null if it
has none); repeated rows each get theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import Tables, chunks, components, hashes, mix, windows, words

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
# Texts of a bucket across components that are compared as pairs, at most; larger
# buckets are compared in blocks of so many texts and bytes of runs.
FEW, BLOCK, BLOCK_BYTES = 12, 512, 2 << 20
# Cells of the dart board drawn at once.
BOARD = 1 << 19
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HASH_BITS = 40


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, lengths: np.ndarray, size: int
) -> np.ndarray:
    """One row of ``size`` dart names per set; all 0 for an empty set.

    elements: 64-bit hashes, set after set; lengths: elements of each set.
    """
    out = np.zeros((len(lengths), size), np.uint64)
    mass = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights, len(lengths))
    starts = np.cumsum(lengths) - lengths
    todo = np.flatnonzero(mass > 0)
    bound = np.zeros(len(lengths))
    bound[todo] = size * (np.log(size) + 2) / mass[todo]
    while len(todo):
        cost = lengths[todo] * np.ceil(bound[todo]) * np.maximum(1, mass[todo] / lengths[todo])
        group = (np.cumsum(cost) // BOARD).astype(np.int64)
        again = []
        for g in np.unique(group):
            sets = todo[group == g]
            own = np.repeat(np.arange(len(sets)), lengths[sets])
            at = np.arange(len(own)) + np.repeat(
                starts[sets] - (np.cumsum(lengths[sets]) - lengths[sets]), lengths[sets]
            )
            names, ranks = _throw(elements[at], weights[at], own, bound[sets], len(sets), size)
            full = np.isfinite(ranks).all(1)
            out[sets[full]] = names[full]
            again.append(sets[~full])
        todo = np.concatenate(again)
        bound[todo] *= 2  # a coordinate without a dart: look further out
    return out


def _throw(x, weight, own, bound, sets, size):
    """Darts of least rank per (set, coordinate): names and ranks."""
    high = np.ceil(weight).astype(np.int64)
    far = np.ceil(bound).astype(np.int64)[own]
    cells = high * far
    who = np.repeat(np.arange(len(x)), cells)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
    up, along = nth // far[who], nth % far[who]
    with np.errstate(over="ignore"):
        cell = mix(mix(x[who] + up.astype(np.uint64) * _GOLDEN) ^ (along.astype(np.uint64) * _GOLDEN + np.uint64(1)))
    # darts in a unit cell are Poisson distributed with mean 1
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 18)])))
    darts = np.searchsorted(steps, _uniform(cell), side="right")
    which = np.repeat(np.arange(len(cell)), darts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    with np.errstate(over="ignore"):
        name = mix(cell[which] + (turn.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        place = mix(name + _GOLDEN)
        rank = along[which] + _uniform(mix(place + _GOLDEN))
    owner = who[which]
    level = up[which] + _uniform(place)
    seen = (level <= weight[owner]) & (rank <= bound[own[owner]])
    name, rank, owner = name[seen], rank[seen], own[owner[seen]]
    slot = owner * size + (name % np.uint64(size)).astype(np.int64)
    best = np.full(sets * size, np.inf)
    np.minimum.at(best, slot, rank)
    first = rank == best[slot]
    names = np.zeros(sets * size, np.uint64)
    names[slot[first]] = name[first]
    return names.reshape(sets, size), best.reshape(sets, size)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word runs of each text: (40-bit hash, times, runs per text), sorted in a text."""
    codes, lengths, vocabulary = words(texts)
    runs, owner, _ = windows(hashes(vocabulary)[codes], lengths, width)
    tagged = np.sort((owner.astype(np.uint64) << np.uint64(_HASH_BITS)) | (runs >> np.uint64(64 - _HASH_BITS)))
    tagged, times = np.unique(tagged, return_counts=True)
    owner = (tagged >> np.uint64(_HASH_BITS)).astype(np.int64)
    return tagged & np.uint64((1 << _HASH_BITS) - 1), times, np.bincount(owner, minlength=len(lengths))


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _HASH_BITS // 8].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) * 8 // _HASH_BITS, 8), np.uint8)
    out[:, : _HASH_BITS // 8] = np.frombuffer(blob, np.uint8).reshape(-1, _HASH_BITS // 8)
    return out.view("<u8").ravel()


def signed(docs: DataFrame, width: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, node, n (runs), bands (one hash each), runs (packed) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                runs, times, counts = shingles(part.column("text"), width)
                weight = times.astype(float) if weighted else np.ones(len(times))
                names = dart_signatures(mix(runs), weight, counts, bands * rows)
                with np.errstate(over="ignore"):
                    band = np.zeros((len(counts), bands), np.uint64)
                    for k in range(rows):
                        band = mix(band * _GOLDEN + names[:, k::rows])
                    band = mix(band + np.arange(bands, dtype=np.uint64)[None, :])
                ends = np.cumsum(counts)
                blobs = [_pack(runs[e - c : e]) for c, e in zip(counts, ends, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
                flat = band[counts > 0].view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("node"),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["doc_id", "node", "n", "bands", "runs"],
                )

    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("node"), text.alias("text"))
    return narrow.mapInArrow(sign, "doc_id long, node long, n long, bands array<long>, runs binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of pairs with both sides' runs."""
    for batch in batches:
        left, right = batch.column("runs_a"), batch.column("runs_b")
        found = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            x, y = _unpack(left[i].as_py()), _unpack(right[i].as_py())
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            found[i] = common / (len(both) - common)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]
        )


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb) whose exact similarity reaches the threshold, as (a, b)."""
    fitting = pairs.where(
        F.least("na", "nb").cast("double") >= F.greatest("na", "nb") * F.lit(threshold)
    )
    runs = texts.select("node", "runs")
    sides = (
        fitting.select("a", "b")
        .join(runs.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), "a")
        .join(runs.select(F.col("node").alias("b"), F.col("runs").alias("runs_b")), "b")
    )
    return (
        sides.mapInArrow(_alike, "a long, b long, similarity double")
        .where(F.col("similarity") >= threshold)
        .select("a", "b")
    )


def _blocks(nodes: Column, load: Column) -> Column:
    """Blocks that a bucket's texts are dealt to: few enough texts and runs in each."""
    return F.greatest(F.ceil(nodes / BLOCK), F.ceil(load * (_HASH_BITS // 8) / BLOCK_BYTES), F.lit(1)).cast("int")


def _joined(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of a group that join components; a forest of them."""
        frame = frame.drop_duplicates("node").sort_values("node", kind="stable")
        left = frame[frame["block"] == frame["i"]]
        right = frame[frame["block"] == frame["j"]]
        runs = [_unpack(x) for x in frame["runs"]]
        size = np.array([len(x) for x in runs])
        # runs of one text only cannot be shared
        values, inverse, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[inverse]
        owner = np.repeat(np.arange(len(frame)), size)
        owner, column = owner[column >= 0], column[column >= 0]
        place = {n: k for k, n in enumerate(frame["node"])}
        x = np.array([place[n] for n in left["node"]], np.int64)
        y = np.array([place[n] for n in right["node"]], np.int64)
        common = np.zeros((len(x), len(y)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(times.size and (times > 1).sum()), 2048):
            lo, hi = np.searchsorted(column, [start, start + 2048])
            dense = np.zeros((len(frame), 2048), np.float32)
            dense[owner[lo:hi], column[lo:hi] - start] = 1
            common += dense[x] @ dense[y].T
        alike = common >= np.float32(threshold) * (size[x][:, None] + size[y][None, :] - common) - 1e-3
        root = {c: c for c in frame["comp"]}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        nodes, comps, out = frame["node"].to_numpy(), frame["comp"].to_numpy(), []
        for p, q in zip(*np.nonzero(alike), strict=True):
            u, v = int(x[p]), int(y[q])
            both = int(common[p, q])
            if u == v or both < threshold * (int(size[u]) + int(size[v]) - both):
                continue
            cu, cv = find(comps[u]), find(comps[v])
            if cu != cv:
                root[max(cu, cv)] = min(cu, cv)
                out.append((min(nodes[u], nodes[v]), max(nodes[u], nodes[v])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _block_links(crowded: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links across components inside large buckets, found block against block.

    crowded: key, node, comp, blocks. A text goes to as many groups as its
    bucket has blocks; a group holds two blocks and gives back at most one link
    for each component it joins to another, so no list of pairs is ever made.
    """
    dealt = crowded.join(texts, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    groups = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block", "node", "comp", "runs",
    )
    return groups.groupBy("key", "i", "j").applyInPandas(_joined(threshold), "a long, b long").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """node, comp: texts of one label are connected; most of a group around a leader has one."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    near = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp"))
    far = both.join(near.select(F.col("node").alias("other"), "comp"), "other")
    return far.groupBy("node").agg(F.least(F.col("node"), F.min("comp"), F.min("other")).alias("comp"))


def _leader_links(first: DataFrame, texts: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """Links of texts with their leaders, one kind after the other.

    A text that a former kind has put into its leader's component is not compared again: its runs
    travel once for most texts.
    """
    links = None
    for kind in range(3):
        pairs = first.where(F.col("kind") == kind).drop("kind").distinct()
        if links is not None:
            comp = tables.cut(_labels(links))
            for side in "ab":
                own = comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
                pairs = pairs.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
            pairs = pairs.where("ca <> cb").drop("ca", "cb")
        found = tables.cut(_links(pairs, texts, threshold))
        links = found if links is None else links.unionByName(found)
    return links


def _classes(
    docs: DataFrame, threshold: float, width: int, bands: int, rows: int, weighted: bool, tables: Tables
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node of every row), and (node, class_id, class_rows, first) of every text.

    first: (doc_id, node) of the row that stands for the class; a missing doc_id comes last.
    """
    sig = tables.cut(signed(docs, width, bands, rows, weighted))
    # one entry per (bucket, node); copies meet in the partial aggregation
    entries = (
        sig.select("node", "n", F.explode("bands").alias("key")).groupBy("key", "node").agg(F.max("n").alias("n"))
    )
    crowds = entries.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    shared = tables.cut(entries.join(crowds, "key"))

    mates = shared.groupBy("node").agg(F.sum("crowd").alias("mates"))
    ranked = shared.join(mates, "node")
    heads = {
        "l0": F.max_by(F.struct("node", "n"), F.struct("mates", "node")),
        "l1": F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(1), "node")),
        "l2": F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(2), "node")),
    }
    leaders = ranked.groupBy("key").agg(*[v.alias(k) for k, v in heads.items()])
    # of the leaders of a text's buckets, the most frequent one of each kind
    offers = shared.join(leaders, "key").select(
        "node", "n", F.posexplode(F.array(*heads)).alias("kind", "leader")
    )
    best = (
        offers.where("leader.node <> node")
        .groupBy("node", "n", "kind", "leader")
        .agg(F.count("*").alias("times"))
        .groupBy("node", "n", "kind")
        .agg(F.max_by("leader", F.struct("times", "leader.node")).alias("leader"))
    )
    before = F.col("node") < F.col("leader.node")
    first = tables.cut(
        best.select(
            "kind",
            F.least("node", "leader.node").alias("a"),
            F.greatest("node", "leader.node").alias("b"),
            F.when(before, F.col("n")).otherwise(F.col("leader.n")).alias("na"),
            F.when(before, F.col("leader.n")).otherwise(F.col("n")).alias("nb"),
        )
    )
    bucketed = shared.select("node").distinct()
    texts = tables.cut(
        sig.select("node", "runs").join(bucketed, "node", "left_semi").groupBy("node").agg(F.first("runs").alias("runs"))
    )
    links = _leader_links(first, texts, threshold, tables)

    # every pair that shares a bucket across components is compared
    placed = shared.join(_labels(links), "node", "left").select(
        "key", "node", "n", F.coalesce("comp", "node").alias("comp")
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("load"))
        .where("lo <> hi")
        .select("key", "m", _blocks(F.col("m"), F.col("load")).alias("blocks"))
    )
    open_ = tables.cut(placed.join(mixed, "key"))
    few = open_.where(F.col("m") <= FEW)
    second = (
        few.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        .join(few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb")), "key")
        .where("a < b AND ca <> cb")
        .where(F.least("na", "nb").cast("double") >= F.greatest("na", "nb") * F.lit(threshold))
        .select("a", "b", "na", "nb")
        .distinct()
    )
    more = tables.cut(
        _links(second, texts, threshold).unionByName(
            _block_links(open_.where(F.col("m") > FEW), texts, threshold)
        )
    )
    comp = components(links.unionByName(more))

    nodes = tables.cut(
        sig.groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        .join(comp.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("comp", F.coalesce("comp", "node"))
    )
    tables.remove(keep=(sig, nodes))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    classes = nodes.groupBy("comp").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"), least.alias("first")
    )
    members = nodes.select("node", "comp").join(classes, "comp").select("node", "class_id", "class_rows", "first")
    return sig.select("doc_id", "node"), members


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """doc_id, class_id, class_rows of every row of ``docs`` (doc_id, text)."""
    named, members = _classes(docs, threshold, width, bands, rows, weighted, Tables())
    return named.join(members, "node").select("doc_id", "class_id", "class_rows")


def keep_one(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """One row of each class, with all its columns: that with the least doc_id.

    Rows are told apart by doc_id and text. If that doc_id has several texts of the class, the one of
    least hash stays; of repeated rows any one stays. Rows without a doc_id stay.
    """
    tables = Tables()
    named, members = _classes(docs, threshold, width, bands, rows, weighted, tables)
    stands = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    named = named.where("doc_id IS NOT NULL").join(members, "node")
    found = tables.cut(named.select("doc_id", "node", stands.alias("stays")))
    tables.remove(keep=(found,))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    marked = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_node")).alias("d")
    gone = found.where("NOT stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_gone")).distinct()
    same = (F.col("d.doc_id").cast("long") == F.col("_id")) & (F.col("d._node") == F.col("_gone"))
    kept = marked.join(gone, same, "left_anti")
    twice = tables.cut(
        found.where("stays").groupBy("doc_id", "node").count().where("count > 1")
        .select(F.col("doc_id").alias("_id"), F.col("node").alias("_gone"))
    )
    if twice.isEmpty():  # the usual case: no second pass over the texts
        return kept.select(*columns)
    once = kept.join(twice, same, "left_anti").select(*columns)
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_node"])
    return once.unionByName(again.select(*columns))
