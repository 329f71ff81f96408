"""Event tables laid out for repeated work: one folder per day, bucketed by encounter.

Rows of one (log_id, combat_id) lie in one bucket, sorted, so grouping by encounter and joining two such
results shuffles nothing. A range of times reads only the folders of its days, and within a file only
the row groups whose statistics reach into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.schemas import COMBAT, EVENTS


def save_events(events: DataFrame, name: str, buckets: int = 64) -> None:
    """Write events as table ``name`` of the catalog; rows without a time lie in a folder of their own.

    Each task writes whole buckets, so a day has at most ``buckets`` files. On a cluster buckets should
    hold some 100 MB a day.
    """
    rows = events.select(*EVENTS.fieldNames()).withColumn("day", F.to_date("ts"))
    placed = rows.repartition(buckets, *COMBAT)
    writer = placed.write.mode("overwrite").format("parquet").partitionBy("day")
    writer.bucketBy(buckets, *COMBAT).sortBy(*COMBAT, "ts", "seq").saveAsTable(name)


def saved_events(spark: SparkSession, name: str, start=None, end=None) -> DataFrame:
    """The events, or those with ts in [start, end]; bounds are timestamps or their text."""
    rows = spark.table(name)
    for bound, keep in ((start, F.col("ts").__ge__), (end, F.col("ts").__le__)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            day = F.to_date(at)
            rows = rows.filter(keep(at) & (F.col("day") >= day if bound is start else F.col("day") <= day))
    return rows.select(*EVENTS.fieldNames())
