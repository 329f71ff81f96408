"""Event and boss-kill tables: CSV and JSON lines in, Parquet, CSV and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish import schemas
from skirmish.functions.scalars import log_time, log_time_text

CSV_COLUMNS = (
    "combat_id", "timestamp", "event", "source", "target", "spell_name", "amount",
    "effective_amount", "type", "zone_id", "zone_name", "spell_id",
)
_SOURCE_NAMES = ("source", "player", "character", "name")
# Bits of a row's number within its task.
ROW_BITS = 33


def read_events(spark: SparkSession, path: str, log_id: str = "main") -> DataFrame:
    """An event CSV of any age as schemas.EVENTS.

    The header decides which columns are there: missing zone and spell columns
    read as 0 and '', the source may be named player, character or name, and a
    bad timestamp is null. Only the header line is read ahead. seq grows in
    the order of file names and of the lines in a file, with gaps.
    """
    head = spark.read.option("header", True).csv(path, inferSchema=False)
    have = head.columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in have])
    rows = spark.read.schema(text).option("header", True).csv(path)
    source = next((c for c in _SOURCE_NAMES if c in have), None)

    def number(name: str, kind: str):
        value = F.col(name).try_cast(kind) if name in have else F.lit(None)
        return F.coalesce(value, F.lit(0)).cast(kind).alias(name)

    def words(name: str):
        return (F.col(name) if name in have else F.lit(None)).cast("string").alias(name)

    # A split is read by one task from its start on; splits are ranked by file and place.
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    ranks = rows.select(*split).distinct().withColumn(
        "_rank", F.row_number().over(Window.orderBy("_file", "_split")).cast("bigint")
    )
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    events = rows.select(
        *split,
        F.lit(log_id).alias("log_id"),
        nth.alias("seq"),
        number("combat_id", "bigint"),
        log_time("timestamp").alias("ts"),
        words("event"),
        (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
        words("target"),
        words("spell_name"),
        number("amount", "bigint"),
        number("effective_amount", "bigint"),
        words("type"),
        number("zone_id", "int"),
        F.coalesce(words("zone_name"), F.lit("")).alias("zone_name"),
        number("spell_id", "bigint"),
    )
    placed = F.shiftleft("_rank", ROW_BITS) + F.col("seq")
    return events.join(ranks, ["_file", "_split"]).withColumn("seq", placed).drop("_file", "_split", "_rank")


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full rewrite as Parquet, one folder per log, files in time order inside."""
    ordered = events.repartition("log_id", F.floor(F.col("seq") / F.lit(1 << 22)))
    ordered = ordered.sortWithinPartitions("log_id", "seq")
    ordered.write.mode(mode).partitionBy("log_id").parquet(path)


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(path).select(*schemas.EVENTS.fieldNames())


def write_events_csv(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows = events.withColumn("timestamp", log_time_text("ts"))
    rows.select(*CSV_COLUMNS).write.mode(mode).option("header", True).csv(path)


def export_table_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any result table as CSV with a header."""
    table.write.mode(mode).option("header", True).csv(path)


def read_boss_kills(spark: SparkSession, path: str, log_id: str = "main") -> DataFrame:
    """Boss kills from JSON lines; bad lines drop out, a missing file is empty.

    seq is the order of the kills: as written, or else by the time of the kill.
    """
    if not path_exists(spark, path):
        rows = spark.createDataFrame([], schemas.BOSS_KILLS_JSON)
    else:
        rows = spark.read.schema(schemas.BOSS_KILLS_JSON).option("mode", "DROPMALFORMED").json(path)
    return rows.select(
        F.coalesce("log_id", F.lit(log_id)).alias("log_id"),
        F.coalesce("seq", F.unix_micros(log_time("end_ts"))).alias("seq"),
        F.coalesce("boss_name", F.lit("Unknown")).alias("boss_name"),
        log_time("start_ts").alias("start_ts"),
        log_time("end_ts").alias("end_ts"),
        F.coalesce("kill_flag", F.lit(0)).alias("kill_flag"),
        F.coalesce("zone_id", F.lit(0)).alias("zone_id"),
    )


def write_boss_kills(kills: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, times as log text; mode overwrite or append."""
    kills.select(
        "log_id",
        "seq",
        "boss_name",
        log_time_text("start_ts").alias("start_ts"),
        log_time_text("end_ts").alias("end_ts"),
        "kill_flag",
        "zone_id",
    ).write.mode(mode).json(path)


def next_combat_id(events: DataFrame) -> DataFrame:
    """Per log: the highest encounter id so far, for numbering to go on."""
    return events.groupBy("log_id").agg(F.coalesce(F.max("combat_id"), F.lit(0)).alias("max_combat_id"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names or is the default."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
