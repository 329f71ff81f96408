"""Session set-up and the lineage cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local work; on a cluster use the one spark-submit gives."""
    builder = (
        SparkSession.builder.master(master)
        .appName("skirmish")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return pin_settings(builder.getOrCreate())


def pin_settings(spark: SparkSession) -> SparkSession:
    """Log times are naive local times: read and compare them all in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A session in one JVM without that setting, as in tests, gets a folder of
    its own. On a cluster a machine-local folder would lose rows without an
    error, so there the setting must be given.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skirmish-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage at a table that several branches read.

    The table is written once to the shared folder and read back, so a lost
    executor loses none of it, later steps read only the columns they need, and
    the planner knows its size. (A checkpoint would compute its input twice.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/skirmish-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
