"""Per-encounter, per-target and per-character figures over the event table.

Every function takes events (see schemas.EVENTS) and returns a DataFrame.
Functions that describe one combat return all combats, one row (or group) per
(log_id, combat_id); filter the result for one of them, and the filter moves
below the aggregation down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.functions.scalars import (
    bracket_label,
    compact_amount,
    damage_total,
    has_text,
    healing_total,
    is_damage,
    is_player_name,
    played_label,
    ratio,
    seconds,
    short_name,
    span_us,
    sum_where,
)
from skirmish.schemas import COMBAT
from skirmish.session import cut


def in_combat(events: DataFrame) -> DataFrame:
    return events.filter(F.col("combat_id") > 0)


def usual_source() -> Column:
    """Most frequent source, the smallest name on ties."""
    return F.mode(F.nullif(F.col("source"), F.lit("")), True)


def _spans(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        span_us(F.min("ts"), F.max("ts")).alias("span_us"),
        damage_total().alias("total_damage"),
        healing_total().alias("total_heal"),
    )


def encounter_stats(events: DataFrame, by: list[str] = COMBAT) -> DataFrame:
    """Span, totals and rates of every encounter."""
    stats = _spans(in_combat(events), by).withColumn("duration_s", seconds("span_us"))
    return stats.withColumns(
        {"dps": ratio("total_damage", "duration_s"), "hps": ratio("total_heal", "duration_s")}
    ).drop("span_us")


def overall_stats(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Encounters, time, totals and rates over all encounters, or per ``by``."""
    keys = [*by, *[c for c in COMBAT if c not in by]]
    encounters = _spans(in_combat(events), keys)
    totals = encounters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_encounters"),
        seconds(F.coalesce(F.sum("span_us"), F.lit(0))).alias("total_duration_s"),
        F.coalesce(F.sum("total_damage"), F.lit(0)).alias("total_damage"),
        F.coalesce(F.sum("total_heal"), F.lit(0)).alias("total_heal"),
        F.coalesce(
            F.max(ratio("total_damage", seconds("span_us"))), F.lit(0.0)
        ).alias("best_dps"),
    )
    return totals.withColumns(
        {
            "avg_dps": ratio("total_damage", "total_duration_s"),
            "avg_hps": ratio("total_heal", "total_duration_s"),
        }
    )


def character_headline(events: DataFrame, characters: list[str] | None = None) -> DataFrame:
    """overall_stats of each source, with its best encounter DPS, in one pass."""
    if characters is not None:
        events = events.filter(F.col("source").isin(*characters))
    return overall_stats(events.filter(has_text("source")), by=("source",)).withColumn(
        "character", short_name("source")
    )


def for_character(events: DataFrame, character: str | None) -> DataFrame:
    return events if character in (None, "All") else events.filter(F.col("source") == character)


def target_totals(events: DataFrame, character: str | None = None) -> DataFrame:
    """Per target: encounters, time it was seen, totals, rates. Combat 0 counts."""
    rows = for_character(events, character).filter(has_text("target"))
    per_combat = _spans(rows, ["target", *COMBAT])
    totals = per_combat.groupBy("target").agg(
        F.count(F.lit(1)).alias("encounters"),
        seconds(F.sum("span_us")).alias("total_time_s"),
        F.sum("total_damage").alias("total_damage"),
        F.sum("total_heal").alias("total_heal"),
    )
    return totals.withColumns(
        {"dps": ratio("total_damage", "total_time_s"), "hps": ratio("total_heal", "total_time_s")}
    )


def totals_view(events: DataFrame, sort: str = "encounters", n: int = 50) -> DataFrame:
    """First n targets by encounters, total_damage, total_time_s or dps."""
    return target_totals(events).orderBy(F.desc(sort), F.desc("total_damage"), "target").limit(n)


def totals_meta(events: DataFrame, character: str | None = None) -> DataFrame:
    """Combats and their total time, and different targets. Combat 0 counts."""
    rows = for_character(events, character)
    combats = rows.groupBy(*COMBAT).agg(span_us(F.min("ts"), F.max("ts")).alias("span_us"))
    time = combats.agg(
        F.count(F.lit(1)).alias("total_combats"),
        seconds(F.coalesce(F.sum("span_us"), F.lit(0))).alias("total_duration_s"),
    )
    targets = rows.filter(has_text("target")).agg(F.count_distinct("target").alias("unique_targets"))
    return time.withColumn("unique_targets", targets.scalar())


def usual_source_per_log(events: DataFrame) -> DataFrame:
    """The owner of each log: its most frequent source."""
    counts = events.filter(has_text("source")).groupBy("log_id", "source").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), "source"))
    return counts.groupBy("log_id").agg(best.alias("b")).select(
        "log_id", F.col("b.source").alias("player")
    )


def top_targets(events: DataFrame, n: int = 10) -> DataFrame:
    """Targets that took most damage, with their DPS over single encounters."""
    fights = in_combat(events)
    per_target = (
        fights.groupBy(*COMBAT, "target")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.when(is_damage(), 1)).alias("hits"),
            damage_total().alias("damage"),
        )
    )
    # The span of the whole combat, next to what each target took in it.
    combat = Window.partitionBy(*COMBAT)
    span = span_us(F.min("start_ts").over(combat), F.max("end_ts").over(combat))
    hit = (
        per_target.withColumn("enc_dps", ratio("damage", seconds(span)))
        .filter((F.col("hits") > 0) & has_text("target"))
        .join(usual_source_per_log(fights), "log_id", "left")
        .filter(_other_than_player())
    )
    ranked = hit.groupBy("target").agg(
        F.sum("damage").alias("total_damage"),
        F.count(F.lit(1)).alias("encounters"),
        F.max("enc_dps").alias("best_dps"),
        F.min("enc_dps").alias("worst_dps"),
        F.avg("enc_dps").alias("avg_dps"),
    )
    return (
        ranked.withColumn("avg_damage", F.col("total_damage") / F.col("encounters"))
        .orderBy(F.desc("total_damage"), "target")
        .limit(n)
    )


def character_counts(events: DataFrame) -> DataFrame:
    """Different combats of each source. Combat 0 counts."""
    pairs = events.filter(has_text("source")).select("source", *COMBAT).distinct()
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("combats"))


def source_options(
    events: DataFrame,
    include_others: bool = False,
    min_combats: int = fixed.MIN_SOURCE_COMBATS,
) -> DataFrame:
    """Selectable sources in order: players, then others seen often enough."""
    counts = character_counts(events).filter(F.trim("source") != "")
    counts = counts.withColumn("is_player", is_player_name("source"))
    keep = F.col("is_player")
    if include_others:
        keep = keep | (F.col("combats") >= min_combats)
    return counts.filter(keep).select("source", "is_player", "combats").orderBy(
        F.desc("is_player"), "source"
    )


def combat_cells(events: DataFrame, by: list[str] = COMBAT) -> DataFrame:
    """One row per (combat, source, target), with the combat's usual source as player.

    What needs the player of a combat next to its sums is built on this, so the
    events are read and shuffled once and only these few rows again.
    """
    died = (F.col("event") == "UNIT_DIED") & has_text("target")
    cells = events.groupBy(*by, "source", "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_damage(), 1)).alias("hits"),
        damage_total().alias("damage"),
        sum_where(is_damage(), "amount").alias("raw_damage"),
        sum_where(F.col("type") == "heal").alias("heal"),
        sum_where(F.col("type") == "absorb").alias("absorb"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.min("seq").alias("first_seq"),
        F.min(F.struct("ts", "seq")).alias("first_time"),
        F.min(F.when(died, F.col("ts"))).alias("died_ts"),
    )
    uses = F.sum("n").over(Window.partitionBy(*by, "source"))
    candidate = F.when(has_text("source"), F.struct((-F.col("_uses")).alias("u"), "source"))
    return (
        cells.repartition(*by)  # serves both windows and the sums per combat after them
        .withColumn("_uses", uses)
        .withColumn("player", F.min(candidate).over(Window.partitionBy(*by))["source"])
        .drop("_uses")
    )


def _other_than_player() -> Column:
    return F.col("player").isNull() | (F.col("target") != F.col("player"))


def combat_headline(events: DataFrame) -> DataFrame:
    """Totals, raw damage, rates, overkill share and time to the first kill."""
    sums = combat_cells(events).groupBy(*COMBAT).agg(
        F.first("player").alias("player"),
        F.min("start_ts").alias("start_ts"),
        span_us(F.min("start_ts"), F.max("end_ts")).alias("span_us"),
        F.sum("damage").alias("total_damage"),
        F.sum("raw_damage").alias("raw_damage"),
        F.sum("heal").alias("total_heal"),
        F.sum("absorb").alias("total_absorb"),
        F.min(F.when(_other_than_player(), F.col("died_ts"))).alias("first_kill_ts"),
    )
    duration = seconds("span_us")
    healing = F.col("total_heal") + F.col("total_absorb")
    return sums.select(
        *COMBAT,
        "player",
        "total_damage",
        "raw_damage",
        "total_heal",
        "total_absorb",
        duration.alias("duration_s"),
        ratio("total_damage", duration).alias("dps"),
        ratio(healing, duration).alias("hps"),
        seconds(F.unix_micros("first_kill_ts") - F.unix_micros("start_ts")).alias("first_kill_s"),
        F.when(
            F.col("raw_damage") > 0,
            (F.col("raw_damage") - F.col("total_damage")) / F.col("raw_damage") * 100,
        ).alias("overkill_pct"),
    )


def time_to_first_kill(events: DataFrame) -> DataFrame:
    return combat_headline(events).select(*COMBAT, "first_kill_s")


def overkill_pct(events: DataFrame) -> DataFrame:
    return combat_headline(events).select(*COMBAT, "overkill_pct")


def combat_players(events: DataFrame) -> DataFrame:
    return events.groupBy(*COMBAT).agg(usual_source().alias("player"))


def damage_by_target(events: DataFrame, top: int | None = None) -> DataFrame:
    """Damage each target took in each combat and its share, the player left out."""
    hit = (
        combat_cells(events)
        .filter((F.col("hits") > 0) & has_text("target") & _other_than_player())
        .groupBy(*COMBAT, "target")
        .agg(F.sum("damage").alias("damage"))
    )
    whole = F.sum("damage").over(Window.partitionBy(*COMBAT))
    shares = hit.select(
        *COMBAT,
        "target",
        "damage",
        F.when(whole > 0, F.col("damage") / whole * 100).alias("pct"),
        short_name("target").alias("label"),
    )
    if top is None:
        return shares
    order = Window.partitionBy(*COMBAT).orderBy(F.desc("damage"), "target")
    return shares.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top).drop("_rank")


def main_target(events: DataFrame, policy: str = "hits") -> DataFrame:
    """The target that names each combat.

    hits: most damage events, owner of the log left out.
    damage: most damage, player of the combat left out; else the first target
    in file order; else the one seen longest.
    header: most damage events, player of the combat left out; else the one
    seen longest; else the first target by time.
    """
    if policy == "hits":
        facts = (
            events.filter(is_damage() & has_text("target"))
            .groupBy(*COMBAT, "target")
            .agg(F.count(F.lit(1)).alias("hits"))
            .join(usual_source_per_log(events), "log_id", "left")
            .filter(_other_than_player())
        )
        top = F.min(F.struct((-F.col("hits")).alias("h"), F.col("target").alias("t")))["t"]
        return facts.groupBy(*COMBAT).agg(top.alias("main_target"))
    facts = (
        combat_cells(events)
        .filter(has_text("target"))
        .groupBy(*COMBAT, "target")
        .agg(
            F.first("player").alias("player"),
            F.sum("hits").alias("hits"),
            F.sum("damage").alias("damage"),
            span_us(F.min("start_ts"), F.max("end_ts")).alias("span_us"),
            F.min("first_seq").alias("first_seq"),
            F.min("first_time").alias("first_time"),
        )
    )
    other = _other_than_player()

    def best(condition: Column, measure: str) -> Column:
        key = F.struct((-F.col(measure)).alias("m"), F.col("target").alias("t"))
        return F.min(F.when(condition, key))["t"]

    most_hits = best(other & (F.col("hits") > 0), "hits")
    most_damage = best(other & (F.col("hits") > 0), "damage")
    longest = best(other & (F.col("span_us") > 0), "span_us")
    choice = {
        "damage": F.coalesce(most_damage, F.min_by("target", "first_seq"), longest),
        "header": F.coalesce(most_hits, longest, F.min_by("target", "first_time")),
    }[policy]
    return facts.groupBy(*COMBAT).agg(choice.alias("main_target")).filter(
        F.col("main_target").isNotNull()
    )


def recent_encounters(
    events: DataFrame, hidden: DataFrame | None = None, n: int = fixed.RECENT_COMBATS
) -> DataFrame:
    """The n newest combats with damage; hidden ones then drop out of these n.

    Newest by time, as ids count per log; what is outside of combat comes last.
    Hidden ids without a log_id hide that id in every log.
    """
    newest = (
        events.filter(is_damage())
        .groupBy(*COMBAT)
        .agg(F.sum("effective_amount").alias("total_damage"), F.min("ts").alias("_begun"))
        .orderBy(F.col("combat_id") == 0, F.desc_nulls_last("_begun"), F.desc("combat_id"), "log_id")
        .limit(n)
        .drop("_begun")
    )
    if hidden is not None:
        keys = [c for c in COMBAT if c in hidden.columns]
        newest = newest.join(hidden.select(*keys).distinct(), keys, "left_anti")
    newest = cut(newest)
    # n rows at most, so a broadcast is safe; what follows reads the events of n combats.
    rows = cut(events.join(F.broadcast(newest.select(*COMBAT)), COMBAT, "left_semi"))
    facts = rows.groupBy(*COMBAT).agg(
        healing_total().alias("total_heal"),
        seconds(span_us(F.min("ts"), F.max("ts"))).alias("duration_s"),
        usual_source().alias("player"),
    )
    return (
        newest.join(facts, COMBAT)
        .join(main_target(rows, "damage"), COMBAT, "left")
        .select(
            *COMBAT,
            F.coalesce(short_name("player"), F.lit("")).alias("player"),
            F.coalesce("main_target", F.lit("")).alias("target"),
            bracket_label("duration_s").alias("duration"),
            "total_damage",
            "total_heal",
        )
    )


def encounter_totals(events: DataFrame) -> DataFrame:
    """Per encounter what ``recent_encounters`` shows of it, to be kept with the events."""
    facts = events.filter(F.col("combat_id") != 0).groupBy(*COMBAT).agg(
        F.min(F.when(is_damage(), F.col("ts"))).alias("begun_ts"),
        usual_source().alias("player"),
        bracket_label(seconds(span_us(F.min("ts"), F.max("ts")))).alias("duration"),
        F.sum(F.when(is_damage(), F.col("effective_amount"))).alias("total_damage"),
        healing_total().alias("total_heal"),
    )
    return facts.join(main_target(events, "damage"), COMBAT, "left").select(
        *COMBAT,
        "begun_ts",
        F.coalesce(short_name("player"), F.lit("")).alias("player"),
        F.coalesce("main_target", F.lit("")).alias("target"),
        "duration",
        "total_damage",
        "total_heal",
    )


def loaded_encounters(events: DataFrame) -> DataFrame:
    """Number of encounters (combat 0 is none) and the newest id."""
    combats = events.select(*COMBAT).distinct()
    return combats.agg(
        F.count(F.when(F.col("combat_id") != 0, 1)).alias("n_encounters"),
        F.coalesce(F.max("combat_id"), F.lit(0)).alias("latest_id"),
    )


def recent_events(
    events: DataFrame, combat_id: int | Column, n: int = 200, log_id: str | None = None
) -> DataFrame:
    """Last n events of one combat by time."""
    wanted = combat_id if isinstance(combat_id, Column) else F.lit(combat_id)
    rows = events.filter(F.col("combat_id") == wanted)
    if log_id is not None:
        rows = rows.filter(F.col("log_id") == log_id)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(n).select(
        "log_id", "seq", "ts", "event", "source", "spell_name", "amount", "effective_amount", "type"
    )


def session_banner(events: DataFrame, day: str | None = None) -> DataFrame:
    """Per calendar day: encounters, time played, best DPS and on whom."""
    rows = in_combat(events).withColumn("day", F.to_date("ts")).filter(F.col("day").isNotNull())
    if day is not None:
        rows = rows.filter(F.col("day") == F.lit(day).cast("date"))
    keys = ["day", *COMBAT]
    per_target = combat_cells(rows, keys).groupBy(*keys, "target").agg(
        F.first("player").alias("player"),
        F.sum("hits").alias("hits"),
        F.sum("damage").alias("damage"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
    )
    on_target = F.when(
        (F.col("hits") > 0) & has_text("target") & _other_than_player(),
        F.struct((-F.col("damage")).alias("d"), "target"),
    )
    combats = per_target.groupBy(*keys).agg(
        span_us(F.min("start_ts"), F.max("end_ts")).alias("span_us"),
        F.sum("hits").alias("hits"),
        F.sum("damage").alias("damage"),
        F.min(on_target)["target"].alias("target"),
    )
    dps = F.col("damage") / F.greatest(seconds("span_us"), F.lit(1.0))
    # Largest DPS first, then the smallest id; combats without damage do not count.
    candidate = F.struct((-dps).alias("neg_dps"), "combat_id", "log_id", "target")
    days = combats.groupBy("day").agg(
        F.count(F.lit(1)).alias("encounters"),
        seconds(F.sum("span_us")).alias("played_s"),
        F.min(F.when(F.col("hits") > 0, candidate)).alias("best"),
    )
    best_dps = F.coalesce(-F.col("best.neg_dps"), F.lit(0.0))
    return days.select(
        "day",
        "encounters",
        "played_s",
        played_label("played_s").alias("played"),
        F.col("best.combat_id").alias("best_combat_id"),
        best_dps.alias("best_dps"),
        compact_amount(best_dps).alias("best_dps_label"),
        F.coalesce(short_name("best.target"), F.lit("")).alias("best_target"),
    )


def hour_activity(encounters: DataFrame) -> DataFrame:
    """Encounters begun in each hour of the day and their mean DPS, 24 rows."""
    hours = encounters.groupBy(F.hour("start_ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("encounters"), F.avg("dps").alias("avg_dps")
    )
    clock = encounters.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return clock.join(hours, "hour", "left").select(
        "hour",
        F.coalesce("encounters", F.lit(0)).alias("encounters"),
        F.coalesce("avg_dps", F.lit(0.0)).alias("avg_dps"),
    )
