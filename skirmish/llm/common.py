"""Helpers of several corpus operators: tables, word hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.session import cut

# Text worked on at once inside a task; bounds the memory of a Python worker.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(df: DataFrame) -> DataFrame:
    """Cut lineage, and let go of the shuffle files behind it.

    Spark drops the files of a shuffle once the driver's JVM has collected the
    plan that used it; a driver with little to do may not collect for hours.
    """
    table_ = cut(df)
    df.sparkSession._jvm.System.gc()
    return table_


class Tables:
    """Tables written on the way to a result, which their owner removes once they have been read."""

    def __init__(self):
        self._written: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self._written.append(released(df))
        return self._written[-1]

    def remove(self, keep: tuple[DataFrame, ...] = ()) -> None:
        """Delete the folders of all tables but those to keep."""
        going = [t for t in self._written if not any(t is k for k in keep)]
        self._written = [t for t in self._written if any(t is k for k in keep)]
        for table_ in going:
            spark = table_.sparkSession
            for file in table_.inputFiles()[:1]:
                folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: (code of each word, words per text, vocabulary).

    Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in vocabulary:  # white space at either end of a text
        real = codes != vocabulary.index("")
        owner = np.repeat(np.arange(len(lengths)), lengths)
        codes, lengths = codes[real], np.bincount(owner[real], minlength=len(lengths))
    return codes, lengths, vocabulary


def hashes(vocabulary: list[str], seed: int = 0) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode(), seed) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(
    hashed: np.ndarray, lengths: np.ndarray, width: int, whole_if_shorter: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words: (hash, text, first word in the text).

    A text with fewer words gives one run of all its words, or none.
    """
    starts = np.cumsum(lengths) - lengths
    total = len(hashed)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(total) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - at
    with np.errstate(over="ignore"):
        value = np.zeros(total, np.uint64)
        for k in range(width):
            step = np.zeros(total, np.uint64)
            step[: total - k] = hashed[k:] if k < total else 0
            inside = left > k
            value = np.where(inside, value * np.uint64(0x9E3779B97F4A7C15) + step, value)
    whole = left >= width
    if whole_if_shorter:
        whole |= (at == 0) & (left < width)
    return mix(value[whole]), text[whole], at[whole]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of integer nodes: (id, comp), comp the least id.

    Alternates large-star and small-star steps. Each is a join on the node with
    a partial minimum before the shuffle, so a node with very many edges costs
    no more than its edges; each round is a written table.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        # large star: all larger neighbours of a node move to its least one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        # small star: all smaller neighbours of a node, and itself, move to the least one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        now = cut(small.where("u <> v").distinct())
        mark = now.agg(
            F.count("*"),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
            F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))), F.lit(0)),
        ).first()
        if mark == before:
            break
        before = mark
    stars = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())
