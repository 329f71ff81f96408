"""Runs: encounters of one zone that follow each other, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.functions.scalars import (
    class_of_spec,
    damage_total,
    has_text,
    healing_total,
    is_player_name,
    known_zone,
    minutes_label,
    ratio,
    seconds,
    short_name,
    span_us,
    sum_where,
)
from skirmish.operators.kills import kills_to_runs, mark_boss_encounters
from skirmish.operators.metrics import in_combat, main_target
from skirmish.operators.scans import sessions
from skirmish.schemas import COMBAT

RUN = ["log_id", "run_id"]


def encounter_summary(events: DataFrame) -> DataFrame:
    """One row per encounter in a known zone: span, totals, zone, main target.

    Zone name and zone id are each the most frequent value, the smallest on ties.
    """
    rows = in_combat(events).filter(known_zone())
    facts = rows.groupBy(*COMBAT).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        seconds(span_us(F.min("ts"), F.max("ts"))).alias("duration_s"),
        damage_total().alias("total_damage"),
        healing_total().alias("total_heal"),
        F.mode("zone_name", True).alias("zone_name"),
        F.coalesce(F.mode("zone_id", True), F.lit(0)).alias("zone_id"),
    )
    return facts.join(main_target(rows, "hits"), COMBAT, "left")


def assign_runs(encounters: DataFrame, gap_minutes: int = fixed.RUN_GAP_MINUTES) -> DataFrame:
    """Add run_id: a new run where the zone changes, or where more than the gap
    lies between the end of one encounter and the start of the next."""
    gap_us = gap_minutes * 60_000_000

    def is_new(prev, now):
        quiet = F.unix_micros(now["start_ts"]) - F.unix_micros(prev["end_ts"])
        return (prev["zone_name"] != now["zone_name"]) | (quiet > gap_us)

    day = F.floor(F.unix_micros("start_ts") / F.lit(86_400_000_000)).cast("bigint")
    return sessions(
        encounters,
        ["log_id"],
        day,
        ["start_ts", "combat_id"],
        ["start_ts", "end_ts", "zone_name"],
        is_new,
        "run_id",
    )


def _run_totals(encounters: DataFrame) -> DataFrame:
    first = F.struct("start_ts", "combat_id")
    totals = encounters.groupBy(*RUN).agg(
        F.min_by("zone_name", first).alias("zone_name"),
        F.min_by("zone_id", first).alias("zone_id"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_encounters"),
        F.sum("total_damage").alias("total_damage"),
        F.sum("total_heal").alias("total_heal"),
        # Durations are whole microseconds: add them as such, exactly.
        seconds(F.sum(F.round(F.col("duration_s") * 1e6).cast("bigint"))).alias("duration_s"),
    )
    return totals.withColumns(
        {
            "avg_dps": ratio("total_damage", "duration_s"),
            "avg_hps": ratio("total_heal", "duration_s"),
        }
    )


def run_roles(events: DataFrame, encounters: DataFrame, healer_spells: DataFrame) -> DataFrame:
    """Role, spec and class of every run.

    A run with any healer spell is a Healer run of the spec of the first such
    event; an id match goes before a name match; of several specs the first by
    name counts. ``encounters`` carry run_id; ``healer_spells`` is (spec,
    spell_id, spell_name). Events are condensed to one row per combat and spell
    before anything is joined.
    """
    rows = in_combat(events).filter(known_zone())
    uses = rows.groupBy(*COMBAT, "spell_id", F.lower("spell_name").alias("spell_name")).agg(
        F.min(F.struct("ts", "seq")).alias("first_use")
    )
    by_id = (
        healer_spells.filter(F.col("spell_id").isNotNull() & (F.col("spell_id") != 0))
        .groupBy("spell_id")
        .agg(F.min("spec").alias("id_spec"))
    )
    by_name = (
        healer_spells.filter(F.col("spell_id").isNull() & F.col("spell_name").isNotNull())
        .groupBy(F.lower("spell_name").alias("spell_name"))
        .agg(F.min("spec").alias("name_spec"))
    )
    matched = (
        uses.join(by_id, "spell_id", "left")
        .join(by_name, "spell_name", "left")
        .withColumn("spec", F.coalesce("id_spec", "name_spec"))
        .filter(F.col("spec").isNotNull())
    )
    runs = encounters.select(*COMBAT, "run_id")
    specs = (
        matched.join(runs, COMBAT)
        .groupBy(*RUN)
        .agg(F.min_by("spec", "first_use").alias("run_spec"))
    )
    all_runs = runs.select(*RUN).distinct()
    return all_runs.join(specs, RUN, "left").select(
        *RUN,
        F.when(F.col("run_spec").isNotNull(), "Healer").otherwise("DPS").alias("run_role"),
        F.col("run_spec").isNotNull().alias("is_healer_run"),
        F.coalesce("run_spec", F.lit("")).alias("run_spec"),
        class_of_spec("run_spec").alias("run_class"),
    )


def runs(
    events: DataFrame,
    encounters: DataFrame,
    kills: DataFrame,
    healer_spells: DataFrame,
) -> DataFrame:
    """Every run with totals, boss kills and role; ``encounters`` carry run_id."""
    totals = kills_to_runs(_run_totals(encounters), kills)
    return totals.join(run_roles(events, encounters, healer_spells), RUN)


def run_headline(run_rows: DataFrame) -> DataFrame:
    return run_rows.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum(F.col("has_boss_kill").cast("bigint")), F.lit(0)).alias("boss_runs"),
        F.count_distinct("zone_name").alias("zones"),
        F.coalesce(F.sum("n_encounters"), F.lit(0)).alias("encounters"),
        F.coalesce(F.sum("total_damage"), F.lit(0)).alias("total_damage"),
        F.coalesce(F.sum("total_heal"), F.lit(0)).alias("total_heal"),
        F.bround(F.avg("avg_dps"), 1).alias("avg_dps"),
        F.bround(F.avg("avg_hps"), 1).alias("avg_hps"),
    )


def filter_runs(
    run_rows: DataFrame, boss_only: bool = False, zones: list[str] | None = None
) -> DataFrame:
    if boss_only:
        run_rows = run_rows.filter("has_boss_kill")
    return run_rows.filter(F.col("zone_name").isin(*zones)) if zones else run_rows


def run_table(run_rows: DataFrame, events: DataFrame, encounters: DataFrame) -> DataFrame:
    """Display rows: the run, the short name of its most frequent source, labels."""
    counts = events.filter(has_text("source")).groupBy(*COMBAT, "source").count()
    players = (
        counts.join(encounters.select(*COMBAT, "run_id"), COMBAT)
        .groupBy(*RUN, "source")
        .agg(F.sum("count").alias("n"))
        .groupBy(*RUN)
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "source"))["source"].alias("player"))
    )
    return run_rows.join(players, RUN, "left").select(
        *RUN,
        "zone_name",
        F.coalesce(short_name("player"), F.lit("")).alias("player"),
        F.col("run_class").alias("player_class"),
        F.col("run_role").alias("role"),
        F.col("boss_names").alias("boss"),
        F.date_format("start_ts", "MM/dd HH:mm").alias("date"),
        F.col("n_encounters").alias("encounters"),
        minutes_label("duration_s").alias("duration"),
        F.col("total_damage").alias("damage"),
        F.col("total_heal").alias("healing"),
        F.bround("avg_dps", 1).alias("avg_dps"),
        F.bround("avg_hps", 1).alias("avg_hps"),
    )


def zone_totals(run_rows: DataFrame) -> DataFrame:
    return run_rows.groupBy("zone_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_damage").alias("total_damage"),
        F.avg("avg_dps").alias("avg_dps"),
    )


def _shares_in_encounters(events: DataFrame, encounters: DataFrame) -> DataFrame:
    """Damage and healing of every source in every encounter of a run."""
    per_source = events.filter(F.col("source").isNotNull()).groupBy(*COMBAT, "source").agg(
        damage_total().alias("damage"), healing_total().alias("healing")
    )
    return per_source.join(encounters.select(*COMBAT, "run_id", "duration_s"), COMBAT)


def _role(source: str):
    return F.when(is_player_name(source), "Player").otherwise("Follower NPC")


def participants(events: DataFrame, encounters: DataFrame) -> DataFrame:
    """Sources of every run with totals, rates over the encounters they were in,
    and shares of the run's damage and healing."""
    totals = (
        _shares_in_encounters(events, encounters)
        .groupBy(*RUN, "source")
        .agg(
            F.sum("damage").alias("damage"),
            F.sum("healing").alias("healing"),
            seconds(F.sum(F.round(F.col("duration_s") * 1e6).cast("bigint"))).alias("active_s"),
        )
        .filter((F.col("damage") != 0) | (F.col("healing") != 0))
    )
    of_run = Window.partitionBy(*RUN)

    def share(amount: str):
        positive = F.when(F.col(amount) > 0, F.col(amount))
        whole = F.sum(positive).over(of_run)
        return F.bround(positive / whole * 100, 1)

    return totals.select(
        *RUN,
        "source",
        short_name("source").alias("short_name"),
        _role("source").alias("role"),
        "damage",
        F.bround(ratio("damage", "active_s"), 1).alias("dps"),
        "healing",
        F.bround(ratio("healing", "active_s"), 1).alias("hps"),
        share("damage").alias("damage_pct"),
        share("healing").alias("healing_pct"),
    )


def participant_trend(events: DataFrame, encounters: DataFrame) -> DataFrame:
    """DPS and HPS of every source in every encounter of a run."""
    rows = _shares_in_encounters(events, encounters).filter(
        (F.col("damage") != 0) | (F.col("healing") != 0)
    )
    return rows.select(
        *RUN,
        "combat_id",
        "source",
        short_name("source").alias("short_name"),
        _role("source").alias("role"),
        F.bround(ratio("damage", "duration_s"), 1).alias("dps"),
        F.bround(ratio("healing", "duration_s"), 1).alias("hps"),
    )


def run_encounters(events: DataFrame, encounters: DataFrame, kills: DataFrame) -> DataFrame:
    """Encounter rows of every run, with absorbs and the boss mark."""
    absorbs = (
        events.filter(F.col("type") == "absorb")
        .groupBy(*COMBAT)
        .agg(sum_where(F.lit(True)).alias("absorb"))
    )
    rows = mark_boss_encounters(encounters, kills).join(absorbs, COMBAT, "left")
    return rows.select(
        *RUN,
        "combat_id",
        F.when(has_text("main_target"), F.col("main_target")).otherwise("—").alias("target"),
        F.date_format("start_ts", "HH:mm:ss").alias("start"),
        minutes_label("duration_s").alias("duration"),
        F.col("total_damage").alias("damage"),
        F.col("total_heal").alias("healing"),
        F.coalesce("absorb", F.lit(0)).alias("absorb"),
        F.bround(ratio("total_damage", "duration_s"), 1).alias("dps"),
        F.bround(ratio("total_heal", "duration_s"), 1).alias("hps"),
        "is_boss",
    )


def run_encounter_bars(rows: DataFrame) -> DataFrame:
    """run_encounters in long form: DPS is the Damage bar, HPS and absorb Support."""
    long = rows.withColumn("absorb", F.col("absorb").cast("double")).unpivot(
        [*RUN, "combat_id", "target", "is_boss"], ["dps", "hps", "absorb"], "stat", "value"
    )
    return long.withColumn("bar", F.when(F.col("stat") == "dps", "Damage").otherwise("Support"))
