"""Shards of bounded size by extendible hashing.

A row's hash is the first 60 bits of the MD5 of its key, as text. A directory
indexed by the leading bits says which bucket a row is in. It starts as one
bucket; a bucket above the byte limit, and no other, is split on the next bit
until every bucket fits. So rows of a shard share the bits of its name, and a
table that grows splits shards but never moves a row between others.

The directory is worked out from sums over hash prefixes, ``STEP`` bits or more
at a time, with partial sums before each shuffle; rows are read again only
while some bucket is still too large after the bits looked at. Rows whose 60
bits agree cannot be told apart by their key. If they are too large for one
shard they go on splitting on the bits of a hash of the whole row, and of the
row's number in a written table, so a key (or a repeated row) that holds a
third of the table is spread too. A shard of one row may exceed the limit.

Null keys hash as the empty text, null texts have 0 bytes. An empty table has
no shards. Columns of the input are kept; ``shard``, ``shard_bits``,
``shard_rows``, ``shard_bytes`` replace columns of those names. ``shard`` is
the string of leading bits, empty for a single shard.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.session import cut

LIMIT_BYTES = 64 << 20
# Bits of one hash, and bits looked at beyond those that even sizes would need.
HASH_BITS, STEP = 60, 3
# A directory of at most so many entries is sent to every task.
SMALL_DIRECTORY = 200_000
RESULT = ("shard", "shard_bits", "shard_rows", "shard_bytes")


def _hash(value: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(hashed: Column, bits: Column | int) -> Column:
    shift = F.lit(HASH_BITS) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.call_function("shiftright", hashed, shift.cast("int"))


def _slots(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Directory of the ``high`` leading bits: _group, _slot, _bits, _n, _sum.

    rows: _group, _h, _bytes. An entry's bucket is its shortest prefix of more
    than ``low`` bits that fits; _bits is null where none does.
    """
    sums = cut(
        rows.groupBy("_group", _prefix(F.col("_h"), high).alias("_slot")).agg(
            F.count("*").alias("_n"), F.sum("_bytes").alias("_sum")
        )
    )
    levels = sums.withColumn("_bits", F.explode(F.sequence(F.lit(low + 1), F.lit(high)))).withColumn(
        "_at", F.call_function("shiftright", "_slot", (F.lit(high) - F.col("_bits")).cast("int"))
    )
    buckets = (
        levels.groupBy("_group", "_bits", "_at")
        .agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
        .where((F.col("_sum") <= limit) | (F.col("_n") == 1))
    )
    fits = (
        levels.select("_group", "_slot", "_bits", "_at")
        .join(buckets, ["_group", "_bits", "_at"])
        .groupBy("_group", "_slot")
        .agg(F.min(F.struct("_bits", "_n", "_sum")).alias("_bucket"))
    )
    return cut(
        sums.select("_group", "_slot")
        .join(fits, ["_group", "_slot"], "left")
        .select("_group", "_slot", "_bucket.*")
    )


def _deal(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Split the groups of ``rows`` on the bits of _h: dealt rows, and rows 60 bits cannot split."""
    narrow = cut(rows.select("_group", "_h", "_bytes"))
    dealt, low = [], -1
    while True:
        volume = (
            narrow.groupBy("_group", _prefix(F.col("_h"), max(low, 0)))
            .agg(F.sum("_bytes").alias("b"))
            .agg(F.coalesce(F.max("b"), F.lit(0)))
            .first()[0]
        )
        need = max(0, math.ceil(math.log2(max(1, volume / limit))))
        high = min(HASH_BITS, max(low, 0) + need + STEP)
        slots = _slots(narrow, low, high, limit)
        left, size = slots.agg(
            F.coalesce(F.sum(F.col("_bits").isNull().cast("int")), F.lit(0)), F.count("*")
        ).first()
        known = F.broadcast(slots) if size <= SMALL_DIRECTORY else slots
        placed = rows.withColumn("_slot", _prefix(F.col("_h"), high)).join(known, ["_group", "_slot"])
        dealt.append(placed.where("_bits IS NOT NULL"))
        if not left:
            return dealt, None
        open_ = F.broadcast(slots.where("_bits IS NULL").select("_group", "_slot")) if left <= SMALL_DIRECTORY else (
            slots.where("_bits IS NULL").select("_group", "_slot")
        )
        rows = rows.withColumn("_slot", _prefix(F.col("_h"), high)).join(open_, ["_group", "_slot"]).drop("_slot")
        if high == HASH_BITS:
            return dealt, rows
        narrow = (
            narrow.withColumn("_slot", _prefix(F.col("_h"), high)).join(open_, ["_group", "_slot"]).drop("_slot")
        )
        low = high


def _bits(value: Column, count: Column) -> Column:
    """The last ``count`` bits of a number as text."""
    return F.when(count == 0, F.lit("")).otherwise(F.lpad(F.conv(value.cast("string"), 10, 2), count, "0"))


def assign_shards(
    docs: DataFrame, key: str = "doc_id", limit: int = LIMIT_BYTES, size: Column | None = None
) -> DataFrame:
    """The rows with the shard they belong to and that shard's rows and bytes.

    size: bytes a row counts for; by default those of ``text`` in UTF-8.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    own = [c for c in docs.columns if c not in RESULT]
    key_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.lit("").alias("_group"),
        _hash(key_text).alias("_h"),
        size.cast("bigint").alias("_bytes"),
    )
    dealt, rest = _deal(rows, limit)
    for further in ("row", "number"):
        if rest is None:
            break
        # one key fills more than a shard: go on with the whole row, then its number
        rest = rest.withColumn("_group", F.concat("_group", _bits(F.col("_h"), F.lit(HASH_BITS))))
        if further == "row":
            rest = cut(
                rest.withColumn("_h", _hash(F.to_json("_row"))).withColumn("_number", F.monotonically_increasing_id())
            )
        else:
            rest = rest.withColumn("_h", _hash(F.col("_number").cast("string")))
        more, rest = _deal(rest, limit)
        dealt += more
    place = F.call_function("shiftright", "_h", (F.lit(HASH_BITS) - F.col("_bits")).cast("int"))
    return reduce(
        DataFrame.unionByName,
        [
            d.select(
                "_row.*",
                F.concat("_group", _bits(place, F.col("_bits"))).alias("shard"),
                (F.length("_group") + F.col("_bits")).alias("shard_bits"),
                F.col("_n").alias("shard_rows"),
                F.col("_sum").alias("shard_bytes"),
            )
            for d in dealt
        ],
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT_BYTES) -> None:
    """Write each shard as one folder ``shard=<bits>`` of Parquet files below ``path``.

    Rows meet by shard, so a folder holds one file; its name is never empty.
    """
    named = assign_shards(docs, key, limit).withColumn("shard", F.concat(F.lit("b"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)


def sql_twin(limit: int = LIMIT_BYTES) -> str:
    """The same shards in SQL, for keys that 60 bits tell apart."""
    return f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0) AS b FROM documents
), p AS (
  SELECT doc_id, b, h, d, h >> (60 - d) AS a FROM r, (SELECT unnest(range(0, 61))::INT AS d)
), t AS (SELECT d, a, count(*) AS n, sum(b)::BIGINT AS bytes FROM p GROUP BY ALL
), f AS (
  SELECT p.*, n, bytes, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k
  FROM p JOIN t USING (d, a) WHERE bytes <= {limit} OR n = 1
)
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(a), 60, '0'), d) END AS shard,
       d AS shard_bits, n AS shard_rows, bytes AS shard_bytes
FROM f WHERE k = 1
"""
