"""Stamping events with the encounter that covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.scans import running, seq_block
from skirmish.session import cut

# Width of the time buckets that turn the interval test into an equality join.
BUCKET_S = 60


def _bucket(us):
    return F.floor(us / F.lit(BUCKET_S * 1_000_000)).cast("bigint")


def _spans(encounters: DataFrame) -> DataFrame:
    """Encounters with the start of the next one and the number of their lap.

    Where an encounter starts before the end of the one before it, the log's
    clock has been set back and a new lap begins (_opens). Within a lap encounters
    follow each other in time, so that one at most covers an event; next_start is
    that of the next encounter of the lap.
    """
    block = seq_block("combat_id")
    latest = F.greatest("start_ts", "end_ts")
    rows = running(encounters, ["log_id"], block, ["combat_id"], {"_prev": ("last", latest)}, before=True)
    back = F.col("open_seq").isNotNull() & (F.col("start_ts") < F.col("_prev"))
    rows = rows.withColumn("_opens", F.coalesce(back, F.lit(False)))
    rows = running(rows, ["log_id"], block, ["combat_id"], {"_lap": ("sum", F.col("_opens").cast("bigint"))})
    rows = running(
        rows.withColumn("_rev", -F.col("combat_id")),
        ["log_id"],
        -block,
        ["_rev"],
        {"next_start": ("last", F.col("start_ts"))},
        before=True,
    )
    same_lap = F.col("next_start") >= latest
    return rows.withColumn("next_start", F.when(same_lap, F.col("next_start")))


def _with_laps(events: DataFrame, opened: DataFrame, most: int) -> DataFrame:
    """Add _lap: how many laps of its log, ``most`` at most, have opened up to an event's line.

    A log's first lines of laps are one sorted list, searched by halving steps.
    """
    starts = opened.groupBy("log_id").agg(F.array_sort(F.collect_list("open_seq")).alias("_starts"))

    def step(lap: Column, width: Column) -> Column:
        # beyond the list's end the start is null, which is not reached
        return F.when(F.get("_starts", lap + width - 1) <= F.col("seq"), lap + width).otherwise(lap)

    widths = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    lap = F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), step))
    return events.join(starts, "log_id", "left").select(*events.columns, lap.cast("bigint").alias("_lap"))


def assign_encounter(events: DataFrame, encounters: DataFrame) -> DataFrame:
    """Add combat_id, zone_id, zone_name of the last encounter begun by ts.

    It must not have ended before ts; otherwise, and for a missing ts, the
    stamp is 0, 0, ''. Every event gets one stamp, also where a log's clock is
    set back: then only encounters of the event's own lap count. Encounters are
    spread over time buckets and joined on (log_id, bucket), and on the lap where
    a clock is set back: each event meets only encounters of its own minute and
    lap, and a crowded minute can be split by the skew join, since no side is
    grouped.
    """
    events = events.drop("combat_id", "zone_id", "zone_name")
    names = events.columns
    first = _bucket(F.unix_micros("start_ts"))
    last = _bucket(F.unix_micros("end_ts"))
    spans = cut(_spans(encounters))
    opened = spans.where("_opens").select("log_id", "open_seq")
    most = opened.groupBy("log_id").count().agg(F.max("count")).first()[0]
    spans = spans.select(
        "log_id", "combat_id", "zone_id", "zone_name", "start_ts", "end_ts", "next_start", "_lap",
        F.explode(F.sequence(first, last)).alias("_bucket"),
    )
    if most:
        events = _with_laps(events, opened, most)
    e = events.withColumn("_bucket", _bucket(F.unix_micros("ts"))).alias("e")
    s = spans.alias("s")
    covered = (
        (F.col("e.log_id") == F.col("s.log_id"))
        & (F.col("e._bucket") == F.col("s._bucket"))
        & (F.col("e.ts") >= F.col("s.start_ts"))
        & (F.col("e.ts") <= F.col("s.end_ts"))
        & (F.col("s.next_start").isNull() | (F.col("e.ts") < F.col("s.next_start")))
    )
    if most:
        covered &= F.col("e._lap") == F.col("s._lap")
    return e.join(s, covered, "left").select(
        *[F.col(f"e.{c}") for c in names],
        F.coalesce("s.combat_id", F.lit(0)).cast("bigint").alias("combat_id"),
        F.coalesce("s.zone_id", F.lit(0)).cast("int").alias("zone_id"),
        F.coalesce("s.zone_name", F.lit("")).alias("zone_name"),
    )
