"""Registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.fixed import HEALING_TYPES
from skirmish.operators import compare as cp
from skirmish.operators import metrics as mt
from skirmish.operators import parse as ps
from skirmish.operators import positions as po
from skirmish.operators import runs as rn
from skirmish.operators import spells as sp
from skirmish.operators import timeseries as tm
from skirmish.plans import adapters as ad
from skirmish.plans.dashboard import encounter_table
from skirmish.plans.import_logs import boss_kills_of, encounters_of, stamped_events
from skirmish.session import cut
from skirmish.sources import sidecars, tables

Query = Callable[[SparkSession, str], DataFrame]

PAIR = ["P0-Realm-EU", "P2-Realm-EU"]
HEALING = list(HEALING_TYPES)
# The whole month the driver's events cover.
MONTH = ("2024-01-01", "2024-02-01")
# Two hours of the replay; its log begins before and ends after.
HOURS = ("2024-01-01 01:00:00", "2024-01-01 03:00:00")


def flat(df: DataFrame, places: int = 6) -> DataFrame:
    """Plain columns for comparison: bigint, rounded double, string, boolean."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, places)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        out.append(c.alias(field.name))
    return df.select(*out)


class _Data:
    """The driver's tables seen as events, encounters, runs, kills and lines."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def ev(self) -> DataFrame:
        return ad.combat_events(self.spark, self.sf_dir)

    @property
    def orders(self) -> DataFrame:
        return ad.combat_from_orders(self.spark, self.sf_dir)

    @cached_property
    def lines(self) -> DataFrame:
        """Log text as a table, as a log import would read it."""
        return cut(ad.raw_lines(self.spark, self.sf_dir))

    @property
    def kills(self) -> DataFrame:
        return ad.combat_kills(self.ev)

    @property
    def healers(self) -> DataFrame:
        return ad.healer_spells(self.ev)

    @cached_property
    def enc(self) -> DataFrame:
        """Encounters with run_id."""
        return encounter_table(self.ev)

    @property
    def roles(self) -> DataFrame:
        return rn.run_roles(self.ev, self.enc, self.healers)

    @property
    def runs(self) -> DataFrame:
        return rn.runs(self.ev, self.enc, self.kills, self.healers)

    @property
    def boss(self) -> DataFrame:
        return cp.boss_encounters(self.ev, self.enc, self.kills, self.roles)

    @property
    def pairs(self) -> DataFrame:
        return cp.pair_exact(cp.fingerprints(self.ev, PAIR), PAIR)

    @cached_property
    def prints(self) -> DataFrame:
        return cut(cp.fingerprints(self.ev))

    @property
    def every_pair(self) -> DataFrame:
        return cp.pair_exact_each(self.prints, cp.every_two(self.prints))

    @property
    def hidden(self) -> DataFrame:
        return mt.in_combat(self.ev).filter("combat_id % 6 = 0").select("combat_id").distinct()

    @property
    def newest(self):
        return self.ev.agg(F.max("combat_id")).scalar()

    @property
    def oldest(self):
        return mt.in_combat(self.ev).agg(F.min("combat_id")).scalar()

    def ids(self, condition: str) -> DataFrame:
        return mt.in_combat(self.ev).filter(condition).select("combat_id").distinct()

    def note_changes(self) -> DataFrame:
        text = F.when(F.col("combat_id") % 6 == 0, "").otherwise(
            F.concat(F.lit("new "), F.col("combat_id").cast("string"))
        )
        return self.ids("combat_id % 4 = 0 or combat_id % 6 = 0").withColumn("note", text)

    def notes(self) -> DataFrame:
        text = F.concat(F.lit("note "), F.col("combat_id").cast("string"))
        return self.ids("combat_id % 3 = 0").withColumn("note", text)


_QUERIES: dict[str, Callable[[_Data], DataFrame]] = {
    # Encounters, targets, characters.
    "encounter_stats": lambda d: mt.encounter_stats(d.ev),
    "overall_stats": lambda d: mt.overall_stats(d.ev),
    "character_headline": lambda d: mt.character_headline(d.ev),
    "target_totals": lambda d: mt.target_totals(d.ev),
    "target_totals_character": lambda d: mt.target_totals(d.ev, PAIR[0]),
    "totals_meta_character": lambda d: mt.totals_meta(d.ev, PAIR[0]),
    "totals_view": lambda d: mt.totals_view(d.ev),
    "totals_meta": lambda d: mt.totals_meta(d.ev),
    "top_targets": lambda d: mt.top_targets(d.ev),
    "character_counts": lambda d: mt.character_counts(d.ev),
    "source_options": lambda d: mt.source_options(d.ev, include_others=True),
    "combat_headline": lambda d: mt.combat_headline(d.ev),
    "damage_by_target": lambda d: mt.damage_by_target(d.ev),
    "damage_by_target_top": lambda d: mt.damage_by_target(d.ev, 3),
    "main_target_hits": lambda d: mt.main_target(d.ev, "hits"),
    "main_target_damage": lambda d: mt.main_target(d.ev, "damage"),
    "main_target_header": lambda d: mt.main_target(d.ev, "header"),
    "recent_encounters": lambda d: mt.recent_encounters(d.ev, d.hidden),
    "loaded_encounters": lambda d: mt.loaded_encounters(d.ev),
    "recent_events": lambda d: mt.recent_events(d.ev, d.newest),
    "session_banner": lambda d: mt.session_banner(d.ev),
    "session_banner_day": lambda d: mt.session_banner(d.ev, "2024-01-10"),
    "hour_activity": lambda d: mt.hour_activity(mt.encounter_stats(d.ev)),
    "next_combat_id": lambda d: tables.next_combat_id(d.ev),
    # Abilities.
    "spell_damage": lambda d: sp.spell_aggregates(d.ev, "damage"),
    "spell_healing": lambda d: sp.spell_aggregates(d.ev, HEALING),
    "combat_spells": lambda d: sp.spell_aggregates(
        d.ev, ["damage", *HEALING], 7, by=("log_id", "combat_id")
    ),
    "character_spells_damage": lambda d: sp.character_spells(d.ev, "damage"),
    "character_spells_healing": lambda d: sp.character_spells(d.ev, HEALING),
    "spell_filter_options": lambda d: sp.spell_filter_options(d.ev),
    "most_cast": lambda d: sp.most_cast(d.ev),
    "most_cast_all": lambda d: sp.most_cast(d.ev, None, None),
    "ability_uptime": lambda d: sp.ability_uptime(d.ev),
    "rotation_timeline": lambda d: sp.rotation_timeline(d.ev),
    # Runs and kills.
    "encounter_runs": lambda d: d.enc,
    "run_roles": lambda d: d.roles,
    "runs": lambda d: d.runs,
    "boss_runs": lambda d: rn.filter_runs(d.runs, True, ["Zone1", "Zone2"]).select(
        "log_id", "run_id", "zone_name", "boss_names", "run_role"
    ),
    "run_headline": lambda d: rn.run_headline(d.runs),
    "run_table": lambda d: rn.run_table(d.runs, d.ev, d.enc),
    "zone_totals": lambda d: rn.zone_totals(d.runs),
    "participants": lambda d: rn.participants(d.ev, d.enc),
    "participant_trend": lambda d: rn.participant_trend(d.ev, d.enc),
    "run_encounters": lambda d: rn.run_encounters(d.ev, d.enc, d.kills),
    "run_encounter_bars": lambda d: rn.run_encounter_bars(rn.run_encounters(d.ev, d.enc, d.kills)),
    "run_abilities_damage": lambda d: sp.run_abilities(d.ev, d.enc, "damage"),
    "run_abilities_healing": lambda d: sp.run_abilities(d.ev, d.enc, HEALING),
    # Series.
    "time_series": lambda d: tm.time_series(mt.in_combat(d.ev), 5),
    "time_series_spell": lambda d: tm.time_series(mt.in_combat(d.ev), 5, "S3"),
    "time_series_spell_damage": lambda d: tm.time_series(mt.in_combat(d.ev), 5, "S3", "damage"),
    "smooth": lambda d: tm.smooth(tm.time_series(mt.in_combat(d.ev), 5), 10, 5),
    "series_long": lambda d: tm.series_long(tm.time_series(mt.in_combat(d.ev), 5)),
    "encounter_trend": lambda d: tm.encounter_trend(mt.encounter_stats(d.ev)),
    "trend_long": lambda d: tm.trend_long(tm.encounter_trend(mt.encounter_stats(d.ev))),
    "cumulative_frames": lambda d: tm.cumulative_frames(d.ev, 60),
    "cumulative_spans": lambda d: tm.cumulative_spans(d.ev),
    # Comparisons.
    "fingerprints": lambda d: cp.fingerprints(d.ev),
    "encounter_sequence": lambda d: cp.encounter_sequence(d.ev),
    "pair_exact": lambda d: d.pairs,
    "pair_alike": lambda d: cp.pair_encounters(cp.fingerprints(d.ev, PAIR), PAIR, 0.5),
    "paired_metrics": lambda d: cp.paired_metrics(d.pairs, d.ev),
    "pair_table": lambda d: cp.pair_table(d.pairs, PAIR),
    "every_pair_exact": lambda d: d.every_pair,
    "every_paired_metrics": lambda d: cp.paired_metrics(d.every_pair, d.ev),
    "every_pair_table": lambda d: cp.pair_table_each(d.every_pair),
    "boss_encounters": lambda d: d.boss,
    "boss_list": lambda d: cp.boss_list(d.boss),
    "kill_overview": lambda d: cp.kill_overview(d.boss),
    "kill_options": lambda d: cp.kill_options(d.boss),
    "newest_kill_deltas": lambda d: cp.newest_kill_deltas(d.boss),
    "rotation_compare": lambda d: cp.rotation_compare(d.ev, d.newest, d.oldest),
    # Orders read as combats: many small encounters, many sources and targets.
    "orders_encounter_stats": lambda d: mt.encounter_stats(d.orders),
    "orders_overall_stats": lambda d: mt.overall_stats(d.orders),
    "orders_target_totals": lambda d: mt.target_totals(d.orders),
    "orders_character_counts": lambda d: mt.character_counts(d.orders),
    "orders_spells": lambda d: sp.spell_aggregates(d.orders, ["damage", *HEALING], None),
    # Side files.
    "upsert_note": lambda d: sidecars.upsert_note(d.notes(), d.note_changes()),
    "toggle_hidden": lambda d: sidecars.toggle_hidden(
        d.ids("combat_id % 2 = 0"), d.ids("combat_id % 3 = 0")
    ),
    # Log text.
    "parse_raw_events": lambda d: ps.parse_raw_events(d.lines).drop("parts"),
    "parse_player_events": lambda d: ps.parse_player_events(d.lines).drop("by_active_player"),
    "parse_zone_changes": lambda d: ps.parse_zone_changes(d.lines),
    "parse_boss_markers": lambda d: ps.parse_boss_markers(d.lines),
    "pair_boss_kills": lambda d: boss_kills_of(d.lines),
    "active_character": lambda d: ps.active_character(d.lines),
    "log_summary": lambda d: ps.log_summary(ps.parse_player_events(d.lines)),
    "extract_positions": lambda d: po.extract_positions(d.lines, *MONTH),
    "position_units": lambda d: po.position_units(d.lines, *MONTH),
    "extract_positions_range": lambda d: po.extract_positions(d.lines, *HOURS),
    "replay_duration": lambda d: po.replay_duration(d.ev),
    "detect_encounters": lambda d: encounters_of(d.lines),
    "stamped_events": lambda d: stamped_events(d.lines, cut(encounters_of(d.lines))),
}


# Without SQL twins, tested by brute force: frames of every second are too many rows to be collected,
# and the greedy choice of every two characters takes SQL a recursion per encounter.
_LARGE: dict[str, Callable[[_Data], DataFrame]] = {
    "cumulative_frames_second": lambda d: tm.cumulative_frames(d.ev),
    "every_pair_alike": lambda d: cp.pair_encounters_each(d.prints, cp.every_two(d.prints), 0.5),
}


def _bound(builds: dict[str, Callable[[_Data], DataFrame]]) -> dict[str, Query]:
    def bind(build: Callable[[_Data], DataFrame]) -> Query:
        return lambda spark, sf_dir: flat(build(_Data(spark, sf_dir)))

    return {name: bind(build) for name, build in builds.items()}


def queries() -> dict[str, Query]:
    return _bound(_QUERIES)


def large_queries() -> dict[str, Query]:
    return _bound(_LARGE)
