"""Boss kills: pairing of markers, and matching with runs and encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.operators.scans import running, seq_block

_HOUR_US = 3_600_000_000


def pair_boss_kills(markers: DataFrame) -> DataFrame:
    """END rows whose previous marker is a START; name and zone come from the START."""
    rows = running(
        markers,
        ["log_id"],
        seq_block(),
        ["seq"],
        {"opener": ("last", F.struct("marker", "ts", "boss_name", "zone_id"))},
        before=True,
    )
    ended = (F.col("marker") == "END") & (F.col("opener.marker") == "START")
    return rows.filter(ended).select(
        "log_id",
        "seq",
        F.col("opener.boss_name").alias("boss_name"),
        F.col("opener.ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        "kill_flag",
        F.col("opener.zone_id").alias("zone_id"),
    )


def _hour(us: Column) -> Column:
    return F.floor(us / F.lit(_HOUR_US)).cast("bigint")


def kills_to_runs(
    runs: DataFrame, kills: DataFrame, grace_min: int = fixed.KILL_GRACE_MINUTES
) -> DataFrame:
    """Add has_boss_kill and boss_names: kills of the run's zone within its time.

    A kill counts for the first run that contains its end, give or take the
    grace after the run. Names stand in kill order.
    """
    last_us = F.unix_micros("end_ts") + grace_min * 60_000_000
    spans = runs.select(
        "log_id", "zone_id", "run_id", "start_ts", last_us.alias("_until"),
        F.explode(F.sequence(_hour(F.unix_micros("start_ts")), _hour(last_us))).alias("_hour"),
    )
    ends = kills.filter(F.col("kill_flag") == 1).select(
        "log_id", "zone_id", "seq", "boss_name", F.unix_micros("end_ts").alias("_at"),
        _hour(F.unix_micros("end_ts")).alias("_hour"),
    )
    inside = (F.col("_at") >= F.unix_micros("start_ts")) & (F.col("_at") <= F.col("_until"))
    first_run = (
        spans.join(ends, ["log_id", "zone_id", "_hour"])
        .filter(inside)
        .groupBy("log_id", "seq", "boss_name")
        .agg(F.min("run_id").alias("run_id"))
    )
    names = first_run.groupBy("log_id", "run_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "boss_name"))).alias("_kills")
    )
    joined = F.array_join(F.transform("_kills", lambda k: k["boss_name"]), ", ")
    return runs.join(names, ["log_id", "run_id"], "left").select(
        *runs.columns,
        F.col("_kills").isNotNull().alias("has_boss_kill"),
        F.coalesce(joined, F.lit("")).alias("boss_names"),
    )


def kills_to_encounters(
    encounters: DataFrame,
    kills: DataFrame,
    tol_s: int = fixed.KILL_TOLERANCE_S,
    inclusive: bool = True,
    match_zone: bool = True,
    first_only: bool = True,
) -> DataFrame:
    """Encounters that end within the tolerance of a kill, with the kill's name.

    ``match_zone``: zones must agree unless one is unknown (0). ``first_only``:
    a kill takes the first encounter by start, an encounter keeps its first
    kill. Otherwise every match counts.
    """
    tol_us = tol_s * 1_000_000
    width = F.lit(max(tol_us, 1))
    mark = F.floor(F.unix_micros("end_ts") / width).cast("bigint")
    e = encounters.withColumn("_mark", F.explode(F.sequence(mark - 1, mark + 1)))
    k = kills.filter(F.col("kill_flag") == 1).select(
        "log_id",
        F.col("seq").alias("kill_seq"),
        "boss_name",
        F.col("zone_id").alias("kill_zone"),
        F.unix_micros("end_ts").alias("_at"),
        mark.alias("_mark"),
    )
    off = F.abs(F.unix_micros("end_ts") - F.col("_at"))
    near = off <= tol_us if inclusive else off < tol_us
    if match_zone:
        near = near & (
            (F.col("kill_zone") == F.col("zone_id"))
            | (F.coalesce("kill_zone", F.lit(0)) == 0)
            | (F.coalesce("zone_id", F.lit(0)) == 0)
        )
    pairs = e.join(k, ["log_id", "_mark"]).filter(near).drop("_mark", "_at", "kill_zone")
    if not first_only:
        return pairs
    by_kill = Window.partitionBy("log_id", "kill_seq").orderBy("start_ts", "combat_id")
    by_combat = Window.partitionBy("log_id", "combat_id").orderBy("kill_seq")
    pairs = pairs.withColumn("_rank", F.row_number().over(by_kill)).filter("_rank = 1")
    return pairs.withColumn("_rank", F.row_number().over(by_combat)).filter("_rank = 1").drop("_rank")


def mark_boss_encounters(encounters: DataFrame, kills: DataFrame) -> DataFrame:
    """Add is_boss: some kill ends less than the tolerance away, in any zone."""
    hits = kills_to_encounters(
        encounters, kills, inclusive=False, match_zone=False, first_only=False
    )
    hits = hits.select("log_id", "combat_id").distinct().withColumn("_boss", F.lit(True))
    return encounters.join(hits, ["log_id", "combat_id"], "left").withColumn(
        "is_boss", F.coalesce("_boss", F.lit(False))
    ).drop("_boss")
