"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words (between ASCII white space). Sources
stand in code point order, null last, and weigh 1, 2, 3, 1, 2, 3, ... They share
the sum of all sizes by weight; no source gets more than ``REPEATS`` times its
own size, and what is cut off is shared anew by weight until none is above.

Every document of a source is due ``target / source_size`` times: a whole
number of copies and a fraction. Fractions become 0 or 1 by pairs. Of two
documents one gains what the other loses in words, by a random choice that
keeps each one's expected copies, until one of them is settled; the open one
meets the next. So a source's words stay exactly on target but for the one
document left open at the end, and expected copies are exact.

Documents are dealt to blocks by hash; a task streams through its blocks in
order and holds one open document a source. The open ones of a block are paired
again in groups of ``FAN`` blocks, and so on up a tree until each source has
one. Random choices are hashes of block, level and doc_id, so reruns and
recomputed tasks agree. Larger
documents are paired first, so that the one left open at the end is a small one. Blocks that a repeated doc_id makes too large are split
by row number.

Null and empty texts have size 0: they are taken 0 times. Repeated rows are
separate documents. Extra columns are ignored, or kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators.scans import running
from skirmish.session import cut

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, 20240613
# Documents of a block, about; blocks that meet at a node of the tree.
BLOCK, FAN = 4096, 64
_TINY = 1e-9


def size_of(text: str = "text"):
    """Words of a text between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """source, source_size, target of each source."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered in blocks by a range sort, so that many sources do not meet in one task
    named = totals.where("source IS NOT NULL")
    ranged = cut(
        named.repartitionByRange("source").withColumn("_part", F.spark_partition_id().cast("long"))
    )
    numbered = running(
        ranged.withColumn("_all", F.lit(1)), ["_all"], F.col("_part"), ["source"],
        {"place": ("sum", F.lit(1))}, before=True,
    ).select("source", "source_size", "place")
    count = named.count()
    numbered = numbered.unionByName(
        totals.where("source IS NULL").select("source", "source_size", F.lit(count).cast("bigint").alias("place"))
    )
    weigh = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(
        numbered.withColumn("weight", weigh[(F.col("place") % len(weights)).cast("int")]).withColumn(
            "limit", F.col("source_size") * float(repeats)
        )
    )
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # sources at their limit leave the sharing, until no other one is above its own
    rate = None
    while True:
        above = F.lit(False) if rate is None else F.col("weight") * rate > F.col("limit")
        held, weight = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (float(whole) - held) / weight if weight else rate or 0.0
        if rate is not None and new <= rate:
            break
        rate = new
    return sources.select(
        "source", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(float(rate or 0.0))).alias("target")
    )


def _chance(parts: tuple) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    value = SEED
    for part in parts:
        value = (value ^ (hash(part) & (2**64 - 1))) * 0x9E3779B97F4A7C15 % 2**64
        value ^= value >> 29
    value = value * 0xBF58476D1CE4E5B9 % 2**64
    return ((value ^ (value >> 32)) >> 11) * 2.0**-53


def _settle(level: int, last: bool):
    """Pair the fractions of each (node, source) of a partition sorted by node and source.

    Rows come back with ``taken`` copies, or open with ``part`` changed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # the open document of the key at hand: [row, part]

        def close(row):
            part = row["part"]
            if last and 0 < part < 1:
                row["part"] = float(_chance((row["node"], row["doc_id"], level, 7)) < part)
            return row

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                here = (row["node"], row["sid"])
                if here != key:
                    if held is not None:
                        out.append(close(held))
                    key, held = here, None
                if not (_TINY < row["part"] < 1 - _TINY):
                    row["part"] = float(round(row["part"]))
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    p, q, s, t = held["part"], row["part"], held["size"], row["size"]
                    up = min((1 - p) * s, q * t)  # words the held one can gain
                    down = min(p * s, (1 - q) * t)  # words it can lose
                    gain = _chance((row["node"], held["doc_id"], row["doc_id"], level)) * (up + down) < down
                    moved = up if gain else -down
                    held["part"], row["part"] = p + moved / s, q - moved / t
                    open_ = [r for r in (held, row) if _TINY < r["part"] < 1 - _TINY]
                    for r in (held, row):
                        if not (_TINY < r["part"] < 1 - _TINY):
                            r["part"] = float(round(r["part"]))
                            out.append(r)
                    held = open_[0] if open_ else None
            if out:
                yield pd.DataFrame(out, columns=frame.columns)
        if held is not None:
            yield pd.DataFrame([close(held)])

    return run


_ROW = "number long, doc_id long, sid long, size long, whole long, part double, node long"


def rounded(due: DataFrame) -> DataFrame:
    """Copies of each row: number, doc_id, sid, size, copies.

    due: number (of the row), doc_id, sid (64-bit name of the source), size, due.
    """
    rows = due.select(
        "number",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        "sid",
        "size",
        F.floor("due").cast("long").alias("whole"),
        (F.col("due") - F.floor("due")).alias("part"),
    )
    blocks = max(1, -(-due.count() // BLOCK))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(blocks))
    placed = rows.withColumn("node", spread)
    crowd = placed.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > 8 * BLOCK)
    placed = placed.join(crowd, "node", "left").withColumn(
        "node",
        F.when(F.col("rows").isNull(), F.col("node")).otherwise(
            F.pmod(F.xxhash64("doc_id", "number"), F.lit(blocks))
        ),
    )
    done, level = [], 0
    now = placed.select(*_ROW.replace(" long", "").replace(" double", "").split(", "))
    while True:
        last = blocks == 1
        keys = ["node"] if level == 0 else ["node", "sid"]
        ordered = now.repartition(*keys).sortWithinPartitions(
            "node", "sid", F.desc("size"), F.xxhash64("doc_id", F.lit(level)), "doc_id", "number"
        )
        table = cut(ordered.mapInPandas(_settle(level, last), _ROW))
        if last:
            return reduce(DataFrame.unionByName, [*done, table]).select(
                "number", "doc_id", "sid", "size", (F.col("whole") + F.col("part").cast("long")).alias("copies")
            )
        settled = F.col("part").isin(0.0, 1.0)
        done.append(table.where(settled))
        now = table.where(~settled).withColumn("node", F.floor(F.col("node") / FAN))
        blocks, level = -(-blocks // FAN), level + 1


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (struct of the kept columns), size, source_size, target, copies of every document."""
    # one table of the rows as they are mixed; the number names a row of it
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("number"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size_of().alias("size"),
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        )
    )
    sid = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    goals = targets(rows).select(F.col("source").alias("_source"), sid.alias("sid"), "source_size", "target")
    # joined by hash so that null meets null; the planner splits a hot source
    due = cut(
        rows.drop("row")
        .withColumn("sid", sid)
        .join(goals, "sid")
        .where(F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("due", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("number", "doc_id", "sid", "size", "source_size", "target", "due")
    )
    copies = due.select("number", "source_size", "target").join(rounded(due).select("number", "copies"), "number")
    return rows.select("number", "size", "row").join(copies, "number").drop("number")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs, ["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns."""
    taken = mix(docs, docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
