"""Filter interaction audit: what each filter removes in every order of five filters.

Filters, on whole texts (null: empty; words: runs without ASCII white space). A
document fails

* A with under 100 words,
* B with 100 * different words < 80 * words,
* C with 100 * letters A-Z > 10 * code points,
* D with any of ``#$%&*|``,
* E if the same text has a row of smaller doc_id anywhere in the table.

Method. Documents that fail the same filters share a mask; per part there are at
most 32. With a mask matrix M (0 where the mask has the filter, else infinite)
and the position of each filter in each of the 120 orders P (the inverse
permutations), the min-plus product min over f of M[m, f] + P[o, f] is the step at which
order o removes mask m. Weighted scatter counts by (order, step) give what goes
where; a mask that holds the filter of a later step is redundant there.

Scale. Texts are read once and leave as a digest, their flags and a part; only those
are shuffled. Rows are pre-aggregated by (doc_id, digest), then by digest, so that
a text or an id on a third of all rows costs one row per task. Equal texts are
known by SHA-256. Only (part, mask) counts reach Python, at most 32 rows per part.

Null texts are empty, and fail A, and E if there is a smaller doc_id with none. A null
doc_id is neither smaller nor larger than another: such a row fails A to D only.
Rows repeated with one doc_id do not remove each other. A null lang is the part ''.
Labels with several rows per doc_id count if any row has the mark; null doc_ids have
no label. Other columns are not read; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.session import cut

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SIGNS = "[#$%&*|]"

ORDERS = ["".join(p) for p in permutations(FILTERS)]
# position of each filter in each order, from 0
POSITIONS = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.transform(F.array(found), lambda words: _bits(text, words))[0]


def _bits(text: Column, words: Column) -> Column:
    number = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        number < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * number,
        100 * capitals.cast("long") > CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]
    bits = F.lit(0)
    for k, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << k).otherwise(0)
    return bits


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        text_mask(text).alias("mask"),
    )
    once = rows.groupBy("doc_id", "digest", "part").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    marks = cut(
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    known = once.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    no = F.lit(False)
    marked = known.unionByName(once.where("doc_id IS NULL"), allowMissingColumns=True).withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}
    )
    # per text, part and labels: all rows, rows with an id, the least id and its rows
    texts = cut(
        marked.groupBy("digest", "part", "good", "toxic").agg(
            F.first("mask").alias("mask"),
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        )
    )
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    split = texts.join(first, "digest").select(
        "part",
        "good",
        "toxic",
        "mask",
        "n",
        (F.col("named") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)).alias("later"),
    )
    both = split.select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("later")).alias("n")),
                F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")),
            )
        ).alias("x"),
    ).where("x.n > 0 OR x.mask < 16")
    return both.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"),
    )


def removal_steps(masks: np.ndarray, positions: np.ndarray = POSITIONS) -> np.ndarray:
    """[mask, order]: the step, from 0, that removes the mask; the number of filters if none does."""
    filters = positions.shape[1]
    has = (masks[:, None] >> np.arange(filters)) & 1
    cost = np.where(has == 1, 0, filters)
    steps = np.full((len(masks), len(positions)), filters)
    for f in range(filters):
        np.minimum(steps, cost[:, f, None] + positions[None, :, f], out=steps)
    return steps


def audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its (mask, n, good, toxic) rows."""
    masks = rows["mask"].to_numpy().astype(np.int64)
    weights = rows[["n", "good", "toxic"]].to_numpy().astype(np.int64)
    orders, filters = POSITIONS.shape
    steps = removal_steps(masks)
    # weighted scatter: [order, step, (n, good, toxic)], the last step holds what is never removed
    lost = np.zeros((orders, filters + 1, 3), np.int64)
    np.add.at(lost, (np.arange(orders)[None, :], steps), weights[:, None, :])
    removed = lost[:, :filters, 0]
    at = np.argsort(POSITIONS, axis=1)  # filter of each step
    fails = ((masks[:, None] >> np.arange(filters)) & 1).astype(bool)
    total = weights[:, 0] @ fails
    unique = weights[:, 0] @ (fails & (fails.sum(1) == 1)[:, None])
    by_filter = np.zeros(filters, np.int64)
    np.add.at(by_filter, at, removed)
    return pd.DataFrame(
        {
            "part": rows["part"].iloc[0],
            "filter_order": np.repeat(ORDERS, filters),
            "step": np.tile(np.arange(1, filters + 1, dtype=np.int32), orders),
            "kept": (weights[:, 0].sum() - removed.cumsum(1)).ravel(),
            "removed": removed.ravel(),
            # a filter fails a fixed number of documents: those not removed by it went before
            "redundant": (total[at] - removed).ravel(),
            "unique_fails": unique[at].ravel(),
            "good_lost": lost[:, :filters, 1].ravel(),
            "toxic_lost": lost[:, :filters, 2].ravel(),
            "shapley": by_filter[at].ravel(),
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module for the columns."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(audit_part, _SCHEMA)


def sql_twin() -> str:
    orders = ", ".join(f"('{order}')" for order in ORDERS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > least, false)::INT AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN first USING (text) LEFT JOIN marks ON marks.doc_id = d.doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), o AS (SELECT * FROM (VALUES {orders}) AS v(filter_order)
), s AS (
  SELECT part, mask, n, good, toxic, filter_order, step::INT AS step,
         (mask >> (ascii(filter_order[step]) - 65)::INT) & 1 = 1 AS fails,
         coalesce(list_bool_or(list_transform(range(1, step), lambda k: (mask >> (ascii(filter_order[k]) - 65)::INT) & 1 = 1)), false) AS gone,
         mask = 1 << (ascii(filter_order[step]) - 65)::INT AS alone
  FROM m, o, range(1, 6) AS r(step)
), g AS (
  SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM g
"""
