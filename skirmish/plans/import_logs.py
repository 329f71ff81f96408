"""The import: log files in; event, encounter and boss-kill tables out, under one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.operators.kills import pair_boss_kills
from skirmish.operators.parse import (
    parse_boss_markers,
    parse_player_events,
    parse_raw_events,
    parse_zone_changes,
)
from skirmish.operators.segment import detect_encounters
from skirmish.operators.stamp import assign_encounter
from skirmish.operators.metrics import encounter_totals
from skirmish.schemas import BOSS_KILLS, ENCOUNTERS, EVENTS, TOTALS
from skirmish.session import cut
from skirmish.sources import manifest
from skirmish.sources.logs import read_raw_logs
from skirmish.sources.tail import positions, read_span

TABLES = {"events": EVENTS, "encounters": ENCOUNTERS, "totals": TOTALS, "boss_kills": BOSS_KILLS}


def encounters_of(lines: DataFrame, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S) -> DataFrame:
    """Encounters of the lines; only combat and death lines are cut into fields."""
    raw = parse_raw_events(lines, events=(*fixed.COMBAT_EVENTS, *fixed.DEATH_EVENTS))
    return detect_encounters(raw, parse_zone_changes(lines), timeout_s)


def boss_kills_of(lines: DataFrame) -> DataFrame:
    """Boss kills of the lines; pairing reads the few markers twice, the lines once."""
    return pair_boss_kills(cut(parse_boss_markers(lines)))


def stamped_events(lines: DataFrame, encounters: DataFrame) -> DataFrame:
    events = assign_encounter(parse_player_events(lines), encounters)
    return events.select(*EVENTS.fieldNames())


def import_lines(
    spark: SparkSession, lines: DataFrame, out: str, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S
) -> None:
    """Replace the tables events, encounters, totals and boss_kills of ``out`` in one commit."""
    found = cut(encounters_of(lines, timeout_s))
    events = stamped_events(lines, found)
    # files of one log and stretch each, so that a log and a range of lines skip the others
    placed = events.repartition("log_id", F.shiftright("seq", 22)).sortWithinPartitions("log_id", "seq")
    folder = manifest.add_folder(placed, out, "events")
    written = spark.read.schema(EVENTS).parquet(f"{out}/{folder}")
    encounters = found.withColumn("batch", F.lit("import")).select(*ENCOUNTERS.fieldNames())
    kills = boss_kills_of(lines).select(*BOSS_KILLS.fieldNames())
    tables = {
        "events": [folder],
        "encounters": [manifest.add_folder(encounters, out, "encounters")],
        "totals": [manifest.add_folder(encounter_totals(written), out, "totals")],
        "boss_kills": [manifest.add_folder(kills, out, "boss_kills")],
    }
    manifest.commit(spark, out, tables, replace=list(tables))


def import_logs(
    spark: SparkSession,
    paths: str | list[str],
    out: str,
    log_id: str | None = None,
    timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S,
) -> None:
    """Plain and gzip log files into the tables of ``out``; the text is read once."""
    import_lines(spark, read_raw_logs(spark, paths, log_id), out, timeout_s)


def import_followed(
    spark: SparkSession, source: str, out: str, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S
) -> dict[str, list[int]]:
    """Import the complete lines of logs that still grow; returns where following must begin.

    ``live.follow_logs(..., begin=...)`` then goes on with the next byte and the next id.
    """
    reached = positions(source)
    spans = [(name, number, 0, end) for name, (number, end) in reached.items()]
    import_lines(spark, read_span(spark, source, spans), out, timeout_s)
    return reached


def imported(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A committed table of ``out``, of imports and of following: events, encounters, totals or boss_kills."""
    return manifest.read_committed(spark, out, name, TABLES[name])
