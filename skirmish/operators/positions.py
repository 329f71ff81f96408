"""Unit positions out of the field tail of damage and healing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.functions.scalars import seconds
from skirmish.operators.parse import parse_raw_events


def _coordinate_index() -> Column:
    """Index of the last adjacent field pair that looks like coordinates."""
    last = F.size("parts") - 5
    number = lambda i: F.abs(F.get("parts", i).try_cast("double"))
    candidates = F.when(last >= 11, F.sequence(last, F.lit(11), F.lit(-1)))
    fits = F.filter(candidates, lambda i: (number(i) > 10) & (number(i + 1) > 10))
    return F.get(fits, F.lit(0))


def _located(lines: DataFrame, start, end) -> DataFrame:
    """Located rows with ts in [start, end]; bounds are timestamps, their text, or columns."""
    heads = parse_raw_events(lines)
    wanted = F.col("event").contains("DAMAGE") | F.col("event").contains("HEAL")
    rows = heads.filter(wanted & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    rows = rows.withColumn("_at", _coordinate_index()).filter(F.col("_at").isNotNull())
    return rows.withColumns(
        {
            "x": F.get("parts", F.col("_at")).try_cast("double"),
            "y": F.get("parts", F.col("_at") + 1).try_cast("double"),
        }
    )


def extract_positions(lines: DataFrame, start, end) -> DataFrame:
    """Where the acting unit stood: t seconds after start, guid, x, y."""
    elapsed = seconds(F.unix_micros("ts") - F.unix_micros(F.lit(start).cast("timestamp")))
    return _located(lines, start, end).select(
        "log_id", "seq", F.bround(elapsed, 2).alias("t"), F.col("src_guid").alias("guid"), "x", "y"
    )


def position_units(lines: DataFrame, start, end) -> DataFrame:
    """Units of the replay: name, and palette slot by first appearance as actor.

    Units first seen as a target have no slot (drawn in the fixed enemy colour).
    """
    rows = _located(lines, start, end)
    sightings = rows.select(
        "log_id",
        F.explode(
            F.array(
                F.struct("seq", F.lit(0).alias("side"), F.col("src_guid").alias("guid"), F.col("src_name").alias("name")),
                F.struct("seq", F.lit(1).alias("side"), F.col("dst_guid").alias("guid"), F.col("dst_name").alias("name")),
            )
        ).alias("u"),
    ).select("log_id", "u.*")
    first = sightings.groupBy("log_id", "guid").agg(
        F.min(F.struct("seq", "side", "name")).alias("f")
    )
    units = first.select(
        "log_id",
        "guid",
        "f.name",
        F.col("f.seq").alias("first_seq"),
        F.when(F.col("f.side") == 0, "actor").otherwise("target").alias("role"),
    )
    order = Window.partitionBy("log_id", "role").orderBy("first_seq")
    slot = (F.row_number().over(order) - 1) % fixed.PALETTE_SLOTS
    return units.withColumn("color_slot", F.when(F.col("role") == "actor", slot)).drop("first_seq")


def replay_duration(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Seconds from the first to the last event of each combat."""
    return events.groupBy(*(by or ["log_id", "combat_id"])).agg(
        seconds(F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("duration_s")
    )
