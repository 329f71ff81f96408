"""Cutting logs into encounters.

An encounter opens with the first hit between the group and an enemy. It closes
when every enemy it met is dead, when a player dies, or when more than the
timeout passes without hostile activity; then it ends at the last such moment.
Hits on a unit that has died before do not count.

A unit is part of a fight from its first hit to its death, and a fight is open while
any of its units lives. So between two cuts, quiet gaps or deaths of players,
encounters are unions of the spans of units: a running maximum finds them. All of it
is windows over blocks of lines and map-side combined sums; no log is one task.
Only logs whose clock runs backwards go through the rule row by row, in parts that
start afresh wherever the log was quiet for longer than the timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed, schemas
from skirmish.functions.scalars import has_text
from skirmish.operators.machine import DEATH, HITS, QUIET, Fight
from skirmish.operators.parse import has_flags, is_enemy, is_friendly
from skirmish.operators.scans import running, seq_block, sessions
from skirmish.session import cut

_PART_SCHEMA = (
    "log_id string, open_seq bigint, start_us bigint, end_us bigint, "
    "enemy_guids array<string>, close_reason string"
)


def hostile_rows(raw: DataFrame) -> DataFrame:
    """Hits between group and enemies, and deaths: the rows that shape encounters."""
    fighting = F.col("event").isin(*fixed.COMBAT_EVENTS)
    enemy = F.when(is_enemy("src_flags") & is_friendly("dst_flags"), F.col("src_guid")).when(
        is_friendly("src_flags") & is_enemy("dst_flags"), F.col("dst_guid")
    )
    died = F.col("event").isin(*fixed.DEATH_EVENTS)
    guid = F.when(fighting, enemy).when(died, F.col("dst_guid"))
    return raw.select(
        "log_id",
        "seq",
        F.unix_micros("ts").alias("us"),
        F.when(died, DEATH).otherwise(HITS).alias("kind"),
        guid.alias("guid"),
        (died & has_flags("dst_flags", fixed.FLAG_PLAYER)).alias("is_player"),
    ).filter(F.col("guid").isNotNull() & ((F.col("kind") == DEATH) | (F.col("guid") != "")))


def _counted(rows: DataFrame) -> DataFrame:
    """Add the number of deaths before each row, and the time of the row before."""
    died = F.when(F.col("kind") == DEATH, 1).otherwise(0)
    return running(
        rows,
        ["log_id"],
        seq_block(),
        ["seq"],
        {"deaths": ("sum", died), "prev_us": ("last", F.col("us"))},
        before=True,
    )


def _condense(rows: DataFrame) -> DataFrame:
    """Activity rows: hits merged per death interval, lap and slot, and the deaths that matter.

    Within a lap the clock does not run backwards, so hits in one slot lie less
    than a timeout apart.
    """
    deaths = rows.filter(F.col("kind") == DEATH)
    first_death = deaths.groupBy("log_id", "guid").agg(F.min("deaths").alias("died_at"))
    hits = (
        rows.filter(F.col("kind") == HITS)
        .groupBy("log_id", "deaths", "lap", "slot", "guid")
        .agg(F.min(F.struct("seq", "us")).alias("head"), F.max(F.struct("seq", "us")).alias("tail"))
        .join(first_death, ["log_id", "guid"], "left")
        .filter(F.col("died_at").isNull() | (F.col("deaths") <= F.col("died_at")))
    )
    merged = hits.groupBy("log_id", "deaths", "lap", "slot").agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.collect_set("guid").alias("guids")
    )
    met = hits.select("log_id", "guid").distinct().withColumn("met", F.lit(True))
    deaths = (
        deaths.join(first_death, ["log_id", "guid"])
        .join(met, ["log_id", "guid"], "left")
        .filter(F.col("is_player") | (F.col("met") & (F.col("deaths") == F.col("died_at"))))
    )
    return merged.select(
        "log_id",
        "lap",
        "slot",
        F.col("head.seq").alias("seq"),
        F.lit(HITS).alias("kind"),
        F.col("head.us").alias("first_us"),
        F.col("tail.us").alias("last_us"),
        "guids",
        F.lit(False).alias("is_player"),
    ).unionByName(
        deaths.select(
            "log_id",
            "lap",
            "slot",
            "seq",
            "kind",
            F.col("us").alias("first_us"),
            F.col("us").alias("last_us"),
            F.array("guid").alias("guids"),
            "is_player",
        )
    )


def _islands(activity: DataFrame) -> DataFrame:
    """Number the stretches of neighbouring slots.

    A slot that lies beyond an empty one after all earlier slots comes more
    than a whole timeout after any activity before it, so no encounter spans
    that gap; after the clock ran backwards nothing is cut until it has caught
    up. Slots are counted once per log, so their number grows with the time a
    log covers, not with its lines.
    """
    slots = activity.select("log_id", "lap", "slot").distinct()
    order = Window.partitionBy("log_id").orderBy("lap", "slot")
    latest = F.max("slot").over(order.rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("_fresh", F.when(F.col("slot") - latest > 1, 1).otherwise(0))
    slots = slots.withColumn(
        "island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_fresh")
    return activity.join(slots, ["log_id", "lap", "slot"])


def _run_parts(timeout_us: int):
    """Run the machine over partitions sorted by (log_id, island, seq), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fight = None, Fight()
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if (row.log_id, row.island) != key:
                    if key is not None:
                        done.append((key[0], fight.finish()))
                    key, fight = (row.log_id, row.island), Fight()
                done.append((key[0], fight.expire(row.first_us, timeout_us)))
                if row.kind == HITS:
                    fight.hits(row.seq, row.first_us, row.last_us, row.guids)
                else:
                    done.append((key[0], fight.death(row.first_us, row.guids[0], row.is_player)))
            yield _frame(done)
        if key is not None:
            yield _frame([(key[0], fight.finish())])

    return run


def _frame(done: list) -> pd.DataFrame:
    rows = [(log_id, *closed) for log_id, closed in done if closed is not None]
    columns = ["log_id", "open_seq", "start_us", "end_us", "enemy_guids", "close_reason"]
    return pd.DataFrame(rows, columns=columns)


def _with_laps(counted: DataFrame) -> DataFrame:
    """Add lap: how often the log's clock has run backwards before a row."""
    if counted.filter(F.col("us") < F.col("prev_us")).isEmpty():
        return counted.withColumn("lap", F.lit(1).cast("bigint"))
    return cut(
        sessions(
            counted, ["log_id"], seq_block(), ["seq"], ["us"], lambda prev, now: now["us"] < prev["us"], "lap"
        )
    )


def _active(rows: DataFrame) -> DataFrame:
    """Hits on living units, the deaths of units met before, and deaths of players (``fell``)."""
    hit, died = F.col("kind") == HITS, F.col("kind") == DEATH
    units = cut(
        rows.groupBy("log_id", "guid").agg(
            F.min(F.when(hit, F.col("seq"))).alias("_met"), F.min(F.when(died, F.col("seq"))).alias("_died")
        )
    )
    alive = F.col("_died").isNull() | (F.col("seq") < F.col("_died"))
    met = F.coalesce(F.col("_met") < F.col("_died"), F.lit(False))
    fell = died & F.col("is_player") & ~met
    kept = (hit & alive) | (died & met & (F.col("seq") == F.col("_died"))) | fell
    return rows.join(units, ["log_id", "guid"]).filter(kept).select("log_id", "seq", "us", "kind", "guid", fell.alias("fell"))


def _parts(active: DataFrame, timeout_us: int) -> DataFrame:
    """Number the parts of each log: nothing outlasts a quiet gap or a player's death.

    A unit's death that lies in a later part than its last hit finds no fight with that unit; it
    counts for nothing, not even as a sign of life, so the parts are cut again without it. Where
    no such death is left, every row counts and no other cut exists.
    """
    hit, died = F.col("kind") == HITS, F.col("kind") == DEATH
    while True:
        parts = cut(
            sessions(
                active,
                ["log_id"],
                seq_block(),
                ["seq"],
                ["us", "fell"],
                lambda prev, now: prev["fell"] | (now["us"] - prev["us"] > timeout_us),
                "part",
            )
        )
        last = parts.filter("NOT fell").groupBy("log_id", "guid").agg(
            F.max(F.when(hit, F.col("part"))).alias("_hit"), F.max(F.when(died, F.col("part"))).alias("_died")
        )
        stale = cut(last.filter("_died > _hit").select("log_id", "guid", F.lit(DEATH).alias("kind")))
        if stale.isEmpty():
            return parts
        active = parts.drop("part").join(stale, ["log_id", "guid", "kind"], "left_anti")


def _merged(parts: DataFrame) -> DataFrame:
    """Encounters of parts: units that live at the same time, from first hit to death, belong together.

    A fight is open while any unit it met lives, so encounters are the unions of these spans. The
    latest end of all spans before decides where one begins; it runs over blocks in parallel.
    """
    hit, died = F.col("kind") == HITS, F.col("kind") == DEATH
    at = F.struct("seq", "us")
    spans = parts.filter("NOT fell").groupBy("log_id", "part", "guid").agg(
        F.min(F.when(hit, at)).alias("head"), F.max(F.when(died, at)).alias("dead")
    )
    spans = cut(spans.withColumn("_from", F.col("head.seq")))
    keys, block = ["log_id", "part"], seq_block("_from")
    reach = F.coalesce("dead.seq", F.lit((1 << 63) - 1))
    spans = running(spans, keys, block, ["_from"], {"_reach": ("max", reach)}, before=True)
    opens = F.when(F.col("_reach").isNull() | (F.col("_from") > F.col("_reach")), F.col("_from"))
    spans = running(spans, keys, block, ["_from"], {"open_seq": ("last", opens)})
    found = spans.groupBy(*keys, "open_seq").agg(
        F.min("head").alias("head"),
        F.max("dead").alias("dead"),
        F.max(F.col("dead").isNull()).alias("_open"),
        F.array_sort(F.collect_set("guid")).alias("enemy_guids"),
    )
    ends = parts.groupBy(*keys).agg(
        F.max(F.when(~F.col("fell"), at)).alias("tail"), F.max(F.when(F.col("fell"), F.col("us"))).alias("fell_us")
    )
    fell = F.col("fell_us").isNotNull()
    end = F.when(~F.col("_open"), F.col("dead.us")).when(fell, F.col("fell_us")).otherwise(F.col("tail.us"))
    reason = F.when(~F.col("_open"), "all_dead").when(fell, "player_death").otherwise(QUIET)
    return found.join(ends, keys).select(
        "log_id",
        "open_seq",
        F.col("head.us").alias("start_us"),
        end.alias("end_us"),
        "enemy_guids",
        reason.alias("close_reason"),
    )


def _row_by_row(counted: DataFrame, timeout_us: int) -> DataFrame:
    """Encounters of logs where the order of lines and the clock disagree, by the rule itself."""
    slot = F.floor(F.col("us") / F.lit(timeout_us)).cast("bigint")
    activity = _islands(_condense(_with_laps(counted).withColumn("slot", slot)))
    parts = activity.repartition("log_id", "island").sortWithinPartitions("log_id", "island", "seq")
    wanted = ["log_id", "island", "seq", "kind", "first_us", "last_us", "guids", "is_player"]
    return parts.select(*wanted).mapInPandas(_run_parts(timeout_us), _PART_SCHEMA)


def encounter_intervals(hostile: DataFrame, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S) -> DataFrame:
    """Encounters without ids and zones, from ``hostile_rows``.

    Logs whose clock runs backwards somewhere, or with a player's death that is an enemy's too, go
    row by row; all others, however large and busy, are cut by built-in steps that no log gathers in
    one task.
    """
    timeout_us = int(round(timeout_s * 1_000_000))
    # Parsed once: what follows reads these narrow rows, not the log text.
    counted = cut(_counted(cut(hostile)))
    back = counted.filter(F.col("us") < F.col("prev_us")).select("log_id").distinct()
    both = counted.groupBy("log_id", "guid").agg(F.max("is_player").alias("_player"), F.max(F.col("kind") == HITS).alias("_hit"))
    odd = cut(back.unionByName(both.filter("_player AND _hit").select("log_id")).distinct())
    if odd.isEmpty():
        found = _merged(_parts(_active(counted), timeout_us))
    else:
        plain = counted.join(odd, "log_id", "left_anti")
        found = _merged(_parts(_active(plain), timeout_us)).unionByName(
            _row_by_row(cut(counted.join(odd, "log_id", "left_semi")), timeout_us)
        )
    return found.select(
        "log_id",
        "open_seq",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
        "enemy_guids",
        "close_reason",
    )


def number_encounters(intervals: DataFrame, zones: DataFrame) -> DataFrame:
    """Ids 1, 2, ... per log in opening order, and the zone in force at opening.

    An encounter that went quiet ended with the log if it is the log's last one.
    """
    newest = intervals.groupBy("log_id").agg(F.max("open_seq").alias("_newest"))
    valid = zones.filter(has_text("zone_name") & (F.col("zone_name") != fixed.UNKNOWN_ZONE))
    marks = valid.select(
        "log_id",
        F.col("seq").alias("open_seq"),
        F.struct("zone_id", "zone_name").alias("_zone"),
        F.lit(0).alias("_opens"),
    )
    rows = intervals.withColumn("_opens", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    rows = running(
        rows,
        ["log_id"],
        seq_block("open_seq"),
        ["open_seq"],
        {"combat_id": ("sum", F.col("_opens")), "in_zone": ("last", F.col("_zone"))},
    )
    ended = (F.col("close_reason") == QUIET) & (F.col("open_seq") == F.col("_newest"))
    reason = F.when(ended, "end_of_log").otherwise(F.col("close_reason"))
    return rows.filter(F.col("_opens") == 1).join(newest, "log_id").select(
        "log_id",
        "combat_id",
        "open_seq",
        "start_ts",
        "end_ts",
        "enemy_guids",
        F.coalesce("in_zone.zone_id", F.lit(0)).alias("zone_id"),
        F.coalesce("in_zone.zone_name", F.lit("")).alias("zone_name"),
        reason.alias("close_reason"),
    )


def detect_encounters(
    raw: DataFrame, zones: DataFrame, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S
) -> DataFrame:
    """Encounters of every log, from parsed raw events and zone changes."""
    intervals = cut(encounter_intervals(hostile_rows(raw), timeout_s))
    return number_encounters(intervals, cut(zones))
