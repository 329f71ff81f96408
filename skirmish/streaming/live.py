"""Following logs while they are written.

One streaming query reads the growing files (``sources.tail``), keeps the open fight,
its enemies and the dead units of each log as keyed state, and puts out encounters
as they close and boss kills as they end. Each micro-batch reads the lines of its
closed encounters again by their bytes, stamps the events, and appends encounters,
events, per-encounter totals and kills under one commit (``sources.manifest``), so
that a retry changes nothing and readers see all of a batch or none. An import
commits to the same tables; ids go on from the highest one committed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skirmish import fixed, schemas
from skirmish.functions.scalars import damage_total, healing_total, is_damage, is_healing
from skirmish.operators.machine import DEATH, HITS, Fight
from skirmish.operators.metrics import encounter_totals
from skirmish.operators.parse import event_parts, flags, has_flags, integer, is_enemy, is_friendly, parse_player_events, part
from skirmish.operators.stamp import assign_encounter
from skirmish.session import cut
from skirmish.sources import manifest
from skirmish.sources.tail import OFFSET_BITS, read_span, tail_logs

ZONE, START, END = "Z", "S", "E"
ENCOUNTER, KILL = "encounter", "kill"
# Wall-clock seconds without lines after which an open encounter closes.
IDLE_S = 60.0
_MARKERS = {"ENCOUNTER_START": START, "ENCOUNTER_END": END}

# What the stateful step puts out: closed encounters and kills, told apart by ``kind``.
_OUTPUT = (
    "kind string, log_id string, open_seq bigint, close_seq bigint, start_us bigint, end_us bigint, "
    "enemy_guids array<string>, zone_id int, zone_name string, close_reason string, boss_name string, kill_flag int"
)
_OUTPUT_NAMES = [f.split()[0] for f in _OUTPUT.split(", ")]
_FIGHT = (
    "open_seq bigint, start bigint, last bigint, zone_id int, zone_name string, in_zone_id int, in_zone_name string, "
    "boss_name string, boss_start bigint, boss_zone int, heard bigint"
)


def signals(lines: DataFrame) -> DataFrame:
    """Hits, deaths, zone changes and boss markers as one stream of narrow rows; lines are read once."""
    events = (*fixed.COMBAT_EVENTS, *fixed.DEATH_EVENTS, "ZONE_CHANGE", *_MARKERS)
    rows = event_parts(lines, events).withColumns({"src_flags": flags(part(2)), "dst_flags": flags(part(6))})
    event = F.col("event")
    shaped = F.size("parts") >= 8
    fighting, died = event.isin(*fixed.COMBAT_EVENTS) & shaped, event.isin(*fixed.DEATH_EVENTS) & shaped
    enemy = F.when(is_enemy("src_flags") & is_friendly("dst_flags"), part(0)).when(
        is_friendly("src_flags") & is_enemy("dst_flags"), part(4)
    )
    zoned = (event == "ZONE_CHANGE") & (F.size("parts") >= 2)
    begins, ends = event == "ENCOUNTER_START", event == "ENCOUNTER_END"
    kind = (
        F.when(fighting, HITS).when(died, DEATH).when(zoned, ZONE).when(begins, START).when(ends, END)
    )
    text = F.when(fighting, enemy).when(died, part(4)).when(zoned, part(1)).otherwise(F.coalesce(part(1), F.lit("Unknown")))
    number = F.when(zoned, integer(part(0))).when(begins | ends, integer(part(4))).otherwise(
        F.when(died & has_flags("dst_flags", fixed.FLAG_PLAYER), 1).otherwise(0)
    )
    out = rows.select(
        "log_id",
        "seq",
        F.unix_micros("ts").alias("us"),
        kind.alias("kind"),
        text.alias("text"),
        number.cast("int").alias("number"),
    )
    named = F.col("text").isNotNull() & ((F.col("kind") == DEATH) | (F.col("text") != ""))
    known = (F.col("kind") != ZONE) | (F.col("text") != fixed.UNKNOWN_ZONE)
    return out.filter(F.col("kind").isNotNull() & (F.col("kind").isin(START, END) | (named & known)))


class FollowFights(StatefulProcessor):
    """The encounter rule and the pairing of boss markers for one log.

    ``fight`` holds the open encounter, the zone and the open boss marker; ``enemies`` the units
    met in the open encounter and whether they live; ``dead`` every unit that has died, which is
    looked up by name and never sent whole. Rows of a micro-batch are put in order here;
    the source bounds how many of a log there are.
    """

    def __init__(self, timeout_us: int, idle_ms: int | None):
        self.timeout_us, self.idle_ms = timeout_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fight = handle.getValueState("fight", _FIGHT)
        self.enemies = handle.getMapState("enemies", "guid string", "alive boolean")
        self.dead = handle.getMapState("dead", "guid string", "since bigint")

    def _load(self) -> None:
        open_seq, start, last, *rest = self.fight.get() if self.fight.exists() else (None, 0, 0, 0, "", 0, "", None, 0, 0, 0)
        (self.zone_id, self.zone_name, self.in_zone_id, self.in_zone_name, self.boss, self.boss_start, self.boss_zone, self.heard) = rest
        self.now = Fight(open_seq=open_seq, start=start, last=last)
        self.stored = {}
        if open_seq is not None:
            self.stored = {k[0]: bool(v[0]) for k, v in self.enemies.iterator()}
            self.now.seen = set(self.stored)
            self.now.alive = {g for g, alive in self.stored.items() if alive}

    def _save(self) -> None:
        now, f = {g: g in self.now.alive for g in self.now.seen}, self.now
        for guid in self.stored.keys() - now.keys():
            self.enemies.removeKey((guid,))
        for guid, alive in now.items():
            if self.stored.get(guid) != alive:
                self.enemies.updateValue((guid,), (alive,))
        self.fight.update(
            (
                f.open_seq, f.start, f.last, self.zone_id, self.zone_name, self.in_zone_id, self.in_zone_name,
                self.boss, self.boss_start, self.boss_zone, self.heard,
            )
        )

    def _closed(self, log_id: str, seq: int, result: tuple | None) -> list[tuple]:
        if result is None:
            return []
        opened, begin, end, guids, reason = result
        return [(ENCOUNTER, log_id, opened, seq, begin, end, guids, self.in_zone_id, self.in_zone_name, reason, None, None)]

    def _row(self, log_id: str, r) -> list[tuple]:
        out, seq, us = [], int(r.seq), int(r.us)
        if r.kind == ZONE:
            self.zone_id, self.zone_name = int(r.number), r.text
        elif r.kind == START:
            self.boss, self.boss_start, self.boss_zone = r.text, us, int(r.number)
        elif r.kind == END:
            if self.boss is not None:
                out.append((KILL, log_id, seq, seq, self.boss_start, us, None, self.boss_zone, None, None, self.boss, int(r.number)))
            self.boss = None
        else:
            out += self._closed(log_id, seq, self.now.expire(us, self.timeout_us))
            if r.kind == DEATH:
                self.dead.updateValue((r.text,), (seq,))
                self.gone[r.text] = True
                out += self._closed(log_id, seq, self.now.death(us, r.text, r.number == 1))
            else:
                if r.text not in self.gone:
                    self.gone[r.text] = self.dead.containsKey((r.text,))
                if not self.gone[r.text]:
                    if self.now.open_seq is None:
                        self.in_zone_id, self.in_zone_name = self.zone_id, self.zone_name
                    self.now.hits(seq, us, us, [r.text])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        self.gone: dict[str, bool] = {}
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            out += self._row(key[0], r)
            self.heard = int(r.seq)
        self._save()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.now.open_seq is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_OUTPUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = self._closed(key[0], self.heard, self.now.finish())
        self._save()
        yield pd.DataFrame(out, columns=_OUTPUT_NAMES)

    def close(self) -> None:
        pass


def follow_fights(
    lines: DataFrame, timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S, idle_s: float | None = IDLE_S
) -> DataFrame:
    """Closed encounters and boss kills of a stream of lines.

    An encounter that goes quiet closes with the next line of its log that tells, or once
    nothing has come of its log for ``idle_s`` by the wall clock (never if None). There is no
    watermark: one late log would lose its rows to the clock of the others.
    """
    lines.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    processor = FollowFights(int(round(timeout_s * 1_000_000)), None if idle_s is None else int(idle_s * 1000))
    found = signals(lines).groupBy("log_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="none" if idle_s is None else "processingTime",
    )
    times = {"start_ts": F.timestamp_micros("start_us"), "end_ts": F.timestamp_micros("end_us")}
    return found.withColumns(times).drop("start_us", "end_us")


# --- what a micro-batch appends ------------------------------------------------------------------

def _closed_spans(closed: DataFrame, files: dict[str, list[int]]) -> list[tuple[str, int, int, int]]:
    """Bytes of the files that hold the lines of closed encounters, from first opener to last closing line."""
    rows = closed.groupBy("log_id").agg(F.min("open_seq").alias("low"), F.max("close_seq").alias("high")).collect()
    by_log: dict[str, list] = {}
    for name, (number, size) in files.items():
        by_log.setdefault(name.split("/")[0], []).append((number, name, size))
    spans = []
    for r in rows:
        for number, name, size in by_log.get(r.log_id, ()):
            first, last = r.low >> OFFSET_BITS, r.high >> OFFSET_BITS
            if first <= number <= last:
                low = r.low - (number << OFFSET_BITS) if number == first else 0
                high = r.high - (number << OFFSET_BITS) + 1 if number == last else size
                spans.append((name, number, low, high))
    return spans


def flush(
    spark: SparkSession,
    batch: DataFrame,
    source: str,
    files: dict[str, list[int]],
    out: str,
    writer: str,
    number: int,
    burn_empty_ids: bool = False,
) -> bool:
    """Append the encounters and kills of a micro-batch under one commit; False if that was done before.

    Only events inside an encounter are kept. An encounter without any takes no id unless
    ``burn_empty_ids``. An encounter that a stop has already closed is not stored again.
    """
    seen = manifest.state(spark, out)
    if seen.writers.get(writer, -1) >= number:
        return False
    rows = cut(batch)
    tables: dict[str, list[str]] = {}
    kills = rows.filter(F.col("kind") == KILL).withColumnRenamed("open_seq", "seq").select(*schemas.BOSS_KILLS.fieldNames())
    closed = rows.filter(F.col("kind") == ENCOUNTER)
    stored = manifest.read_committed(spark, out, "encounters", schemas.ENCOUNTERS, seen)
    closed = cut(closed.join(stored.filter("open_seq IS NOT NULL").select("log_id", "open_seq"), ["log_id", "open_seq"], "left_anti"))
    if not kills.isEmpty():
        tables["boss_kills"] = [manifest.add_folder(kills, out, "boss_kills")]
    spans = _closed_spans(closed, files)
    if spans:
        order = Window.partitionBy("log_id").orderBy("open_seq")
        closed = cut(closed.withColumn("combat_id", F.row_number().over(order).cast("bigint")))
        events = parse_player_events(read_span(spark, source, spans))
        stamped = assign_encounter(events, closed).join(
            closed.select("log_id", "combat_id", "open_seq", "close_seq"), ["log_id", "combat_id"]
        )
        inside = F.col("seq").between(F.col("open_seq"), F.col("close_seq"))
        stamped = cut(stamped.filter(inside).drop("open_seq", "close_seq"))
        if not burn_empty_ids:
            closed = closed.join(stamped.select(*schemas.COMBAT).distinct(), schemas.COMBAT, "left_semi")
        before = stored.groupBy("log_id").agg(F.max("combat_id").alias("_base"))
        nth = F.row_number().over(Window.partitionBy("log_id").orderBy("open_seq"))
        ids = cut(
            closed.withColumn("_nth", nth)
            .join(before, "log_id", "left")
            .withColumn("new_id", (F.coalesce("_base", F.lit(0)) + F.col("_nth")).cast("bigint"))
        )
        kept = ids.withColumn("combat_id", F.col("new_id")).withColumn("batch", F.lit(f"{writer}-{number}"))
        tables["encounters"] = [manifest.add_folder(kept.select(*schemas.ENCOUNTERS.fieldNames()), out, "encounters")]
        renamed = stamped.join(ids.select(*schemas.COMBAT, "new_id"), schemas.COMBAT).withColumn("combat_id", F.col("new_id"))
        folder = manifest.add_folder(
            renamed.select(*schemas.EVENTS.fieldNames()).sortWithinPartitions("log_id", "seq"), out, "events"
        )
        written = spark.read.schema(schemas.EVENTS).parquet(f"{out}/{folder}")
        tables["events"] = [folder]
        tables["totals"] = [manifest.add_folder(encounter_totals(written), out, "totals")]
    return manifest.commit(spark, out, tables, writer=writer, batch=number)


def follow_logs(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    begin: dict | None = None,
    timeout_s: float = fixed.ENCOUNTER_TIMEOUT_S,
    idle_s: float = IDLE_S,
    burn_empty_ids: bool = False,
    once: bool = True,
    max_bytes: int | None = None,
    every: str = "3 seconds",
) -> StreamingQuery:
    """Follow the files below ``source``; append closed encounters, their events and kills to ``out``.

    ``begin``: where to start in files already there (``tail.positions`` for their ends, or what
    ``import_logs.import_followed`` returned), else at their first line. ``once`` works off what is there, in steps of
    ``max_bytes`` a file, and stops; an idle encounter then stays open.
    """
    limits = {} if max_bytes is None else {"max_bytes": max_bytes}
    lines = tail_logs(spark, source, begin, **limits)
    found = follow_fights(lines, timeout_s, None if once else idle_s)
    # Batches count per checkpoint; so does what this writer has committed.
    writer = f"follow:{checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        flush(spark, batch, source, _offsets(spark, checkpoint, number), out, writer, number, burn_empty_ids)

    stream = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    query = stream.trigger(processingTime="0 seconds" if once else every).start()
    if once:
        query.processAllAvailable()
        query.stop()
    return query


def _offsets(spark: SparkSession, checkpoint: str, number: int | None = None) -> dict[str, list[int]]:
    """Number and read bytes of every file, as the query noted them for a micro-batch (None: the newest)."""
    noted = spark.read.text(f"{checkpoint}/offsets/{'*' if number is None else number}", wholetext=True)
    rows = noted.select("value", F.regexp_extract("_metadata.file_path", r"(\d+)$", 1).cast("long").alias("batch"))
    newest = rows.where("batch IS NOT NULL").agg(F.max_by("value", "batch")).first()[0]
    return json.loads(newest.strip().splitlines()[-1]) if newest else {}


def live_encounters(spark: SparkSession, out: str) -> DataFrame:
    return manifest.read_committed(spark, out, "encounters", schemas.ENCOUNTERS)


def live_events(spark: SparkSession, out: str) -> DataFrame:
    return manifest.read_committed(spark, out, "events", schemas.EVENTS)


def live_kills(spark: SparkSession, out: str) -> DataFrame:
    return manifest.read_committed(spark, out, "boss_kills", schemas.BOSS_KILLS)


def live_view(spark: SparkSession, out: str, n: int = fixed.RECENT_COMBATS) -> tuple[DataFrame, DataFrame]:
    """What the live page shows: newest encounters, their number and the newest id.

    Reads the per-encounter totals that each batch leaves, not the events; empty before the first flush.
    """
    totals = manifest.read_committed(spark, out, "totals", schemas.TOTALS)
    newest = totals.filter("total_damage IS NOT NULL").orderBy(
        F.desc_nulls_last("begun_ts"), F.desc("combat_id"), "log_id"
    )
    loaded = totals.agg(F.count("*").alias("n_encounters"), F.coalesce(F.max("combat_id"), F.lit(0)).alias("latest_id"))
    return newest.limit(n).drop("begun_ts"), loaded


def close_at_stop(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """When following ends for good: store what is still open, straight from the query's state."""
    state = spark.read.format("statestore").option("path", checkpoint)
    fights = state.option("stateVarName", "fight").load().select("key.*", "value.*").filter("open_seq IS NOT NULL")
    state = spark.read.format("statestore").option("path", checkpoint)
    enemies = state.option("stateVarName", "enemies").load()
    guids = enemies.select("key.*", "user_map_key.*").groupBy("log_id").agg(F.array_sort(F.collect_set("guid")).alias("enemy_guids"))
    open_now = fights.join(guids, "log_id", "left").select(
        F.lit(ENCOUNTER).alias("kind"),
        "log_id",
        "open_seq",
        F.col("heard").alias("close_seq"),
        "enemy_guids",
        F.col("in_zone_id").alias("zone_id"),
        F.col("in_zone_name").alias("zone_name"),
        F.lit("end_of_log").alias("close_reason"),
        F.lit(None).cast("string").alias("boss_name"),
        F.lit(None).cast("int").alias("kill_flag"),
        F.timestamp_micros("start").alias("start_ts"),
        F.timestamp_micros("last").alias("end_ts"),
    )
    writer = f"stop:{checkpoint}"
    number = manifest.state(spark, out).writers.get(writer, -1) + 1
    flush(spark, open_now, source, _offsets(spark, checkpoint), out, writer, number)


# --- series over a stream --------------------------------------------------------------------------

SERIES = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("combat_id", T.LongType()),
        T.StructField("bucket_ts", T.TimestampType()),
        T.StructField("dps", T.LongType()),
        T.StructField("hps", T.LongType()),
    ]
)
_SEEN = T.StructType([T.StructField("batch", T.LongType()), T.StructField("newest", T.TimestampType()), T.StructField("late", T.LongType())])


def series_partials(events: DataFrame, step_s: int) -> DataFrame:
    """Damage and healing per bucket; sums of several batches add up."""
    rows = events.filter((is_damage() | is_healing()) & F.col("ts").isNotNull())
    return (
        rows.groupBy(F.window("ts", f"{step_s} seconds").alias("w"), *schemas.COMBAT)
        .agg(damage_total().alias("dps"), healing_total().alias("hps"))
        .select(*schemas.COMBAT, F.col("w.start").alias("bucket_ts"), F.col("dps").cast("long"), F.col("hps").cast("long"))
    )


def follow_series(
    spark: SparkSession, events: DataFrame, out: str, checkpoint: str, step_s: int, delay_s: float = 10.0, once: bool = True
) -> StreamingQuery:
    """Bucket sums of a stream of events, batch by batch; late rows are set aside and counted.

    A row is late if its bucket ended more than ``delay_s`` before the newest time of earlier batches.
    Late rows go to the table ``late`` as they are, and their number to ``series_batches``; nothing is
    dropped unseen. The series is the sum of the partial rows (``series``).
    """
    writer = f"series:{checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        seen = manifest.state(spark, out)
        if seen.writers.get(writer, -1) >= number:
            return
        newest = manifest.read_committed(spark, out, "series_batches", _SEEN, seen).agg(F.max("newest")).first()[0]
        rows = batch.filter(is_damage() | is_healing())
        ends = F.window("ts", f"{step_s} seconds")["end"]
        border = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL '{delay_s}' SECOND")
        rows = cut(rows.withColumn("_late", F.coalesce(ends <= border, F.lit(False))))
        watch = Observation()
        marked = rows.observe(
            watch, F.max("ts").alias("newest"), F.coalesce(F.sum(F.col("_late").cast("long")), F.lit(0)).alias("late")
        )
        partial = series_partials(marked.filter(~F.col("_late")).drop("_late"), step_s)
        tables = {"series": [manifest.add_folder(partial, out, "series")]}
        counts = watch.get
        if counts["late"]:
            late = rows.filter("_late").select(*schemas.EVENTS.fieldNames())
            tables["late"] = [manifest.add_folder(late, out, "late")]
        one = spark.createDataFrame([(number, counts["newest"], counts["late"])], _SEEN)
        tables["series_batches"] = [manifest.add_folder(one.coalesce(1), out, "series_batches")]
        manifest.commit(spark, out, tables, writer=writer, batch=number)

    stream = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="3 seconds")).start()


def series(spark: SparkSession, out: str) -> DataFrame:
    """The series so far."""
    rows = manifest.read_committed(spark, out, "series", SERIES)
    return rows.groupBy(*schemas.COMBAT, "bucket_ts").agg(F.sum("dps").alias("dps"), F.sum("hps").alias("hps"))


def late_rows(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(late rows, per batch newest time and number of late rows)."""
    return (
        manifest.read_committed(spark, out, "late", schemas.EVENTS),
        manifest.read_committed(spark, out, "series_batches", _SEEN),
    )
