"""Raw log files as one ordered table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.session import cut

EPOCH = "1970-01-01 00:00:00"


def file_log_ts(name="_file"):
    """Time written in a log file's name as MMDDYY_HHMMSS after the first dash; the minimum if bad."""
    c = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.txt(\.gz)?$", "")
    stamp = F.regexp_extract(stem, r"^[^-]*-([0-9]{6}_[0-9]{6})$", 1)
    return F.coalesce(
        F.try_to_timestamp(stamp, F.lit("MMddyy_HHmmss")), F.lit(EPOCH).cast("timestamp")
    )


def with_file_columns(lines: DataFrame) -> DataFrame:
    """Add the file, its split and the log it belongs to: the folder's name."""
    path = F.col("_metadata.file_path")
    return lines.select(
        "value",
        F.regexp_extract(path, r"([^/]*)/[^/]*$", 1).alias("log_id"),
        path.alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
    )


def number_lines(lines: DataFrame, log_id: str | None = None) -> DataFrame:
    """seq = 0, 1, 2, ... per log: files by the time in their name, lines as they stand.

    The text is read once and kept as a table. Lines keep their order within a
    file split, so each is numbered from the count of lines in the splits
    before it. Only one row per split is sorted. The planner knows the size of
    that table and broadcasts it while it is small; then no line is shuffled.
    """
    if log_id is not None:
        lines = lines.withColumn("log_id", F.lit(log_id))
    rows = cut(lines.withColumn("_row", F.monotonically_increasing_id()))
    splits = rows.groupBy("log_id", "_file", "_split").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    order = Window.partitionBy("log_id").orderBy(file_log_ts("_file"), "_file", "_split")
    before = F.sum("_lines").over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = cut(
        splits.select(
            "log_id", "_file", "_split", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")
        )
    )
    return rows.join(splits, ["log_id", "_file", "_split"]).select(
        "log_id", (F.col("_row") + F.col("_shift")).cast("bigint").alias("seq"), "value"
    )


def read_raw_logs(spark: SparkSession, paths: str | list[str], log_id: str | None = None) -> DataFrame:
    """Plain and gzip log files as lines(log_id, seq, value)."""
    return number_lines(with_file_columns(spark.read.text(paths)), log_id)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and modificationTime of the files; their content is not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "modificationTime")


def latest_log_only(spark: SparkSession, paths: str | list[str], log_id: str | None = None) -> DataFrame:
    """Lines of the most recently modified file only; no other file is read."""
    newest = _files(spark, paths).select(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    return read_raw_logs(spark, newest, log_id)


def source_freshness(spark: SparkSession, paths: str | list[str], now=None) -> DataFrame:
    """Seconds since any file of a source was last written."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    written = F.max("modificationTime")
    age = F.floor((F.unix_micros(at) - F.unix_micros(written)) / F.lit(1_000_000))
    label = F.when(age < 60, F.format_string("%ds", age)).otherwise(
        F.format_string("%dm %ds", F.floor(age / 60).cast("bigint"), age % 60)
    )
    return _files(spark, paths).agg(age.alias("age_s"), label.alias("label"))
