"""Ability tables: totals, shares, use counts, uptime, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.functions.scalars import has_text, ratio, seconds, span_us, spell_label
from skirmish.operators.metrics import in_combat
from skirmish.schemas import COMBAT

TIMELINE_TYPES = ("damage", *fixed.HEALING_TYPES)


def first_rows(df: DataFrame, by: list[str], order: list, n: int | None) -> DataFrame:
    """First n rows by order, of the whole or of each ``by`` group; all for None."""
    if n is None:
        return df
    if not by:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def spell_aggregates(
    events: DataFrame,
    types: str | list[str] | tuple[str, ...],
    top_n: int | None = 10,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Per ability: count, total, average, share of all abilities, dominant type.

    The share is taken before the cut to ``top_n``, over the ``by`` group. With
    one type only, the type column ``kind`` is left out.
    """
    many = not isinstance(types, str)
    wanted = list(types) if many else [types]
    by = list(by)
    per_type = (
        events.filter(F.col("type").isin(*wanted) & has_text("spell_name"))
        .groupBy(*by, F.col("spell_name").alias("spell"), "type")
        .agg(F.sum("effective_amount").alias("t"), F.count("effective_amount").alias("c"))
    )
    kind = F.min(F.struct((-F.col("t")).alias("n"), "type"))["type"]
    totals = per_type.groupBy(*by, "spell").agg(
        kind.alias("kind"), F.sum("c").alias("count"), F.sum("t").alias("total")
    )
    whole = F.sum("total").over(Window.partitionBy(*by))
    table = totals.select(
        *by,
        "spell",
        *(["kind"] if many else []),
        "count",
        "total",
        ratio("total", "count").alias("avg"),
        F.when(whole > 0, F.col("total") / whole * 100).alias("pct"),
    )
    if top_n is None:
        return table
    return first_rows(table, by, [F.desc("total"), F.col("spell")], top_n)


def character_spells(events: DataFrame, types, top_n: int = 10) -> DataFrame:
    """Best abilities of every source over its encounters."""
    return spell_aggregates(in_combat(events), types, top_n, by=("source",))


def spell_filter_options(events: DataFrame, top_n: int = fixed.DEFAULT_ABILITIES) -> DataFrame:
    """Choices for the spell filter of time_series, in order, of every combat:
    its best damage abilities, then its best healing abilities; ``spell`` and
    ``kind`` are the arguments of time_series that the option stands for."""

    def options(types, kind: str, side: int) -> DataFrame:
        best = spell_aggregates(events, types, top_n, by=tuple(COMBAT))
        return best.select(
            *COMBAT,
            F.lit(side).alias("side"),
            "total",
            "spell",
            F.lit(kind.lower()).alias("kind"),
            F.concat("spell", F.lit(f" [{kind}]")).alias("option"),
        )

    both = options("damage", "Damage", 0).unionByName(options(list(fixed.HEALING_TYPES), "Healing", 1))
    order = Window.partitionBy(*COMBAT).orderBy("side", F.desc("total"), "spell")
    return both.select(*COMBAT, F.row_number().over(order).alias("position"), "option", "spell", "kind")


def most_cast(events: DataFrame, n: int | None = 25, of: int | None = 40) -> DataFrame:
    """Most used abilities among the best ``of`` by damage and by healing; all for None.

    Healing abilities carry the label heal.
    """
    fights = in_combat(events)
    damage = spell_aggregates(fights, "damage", of).withColumn("type", F.lit("damage"))
    healing = spell_aggregates(fights, list(fixed.HEALING_TYPES), of).drop("kind")
    both = damage.unionByName(healing.withColumn("type", F.lit("heal")))
    return first_rows(both, [], [F.desc("count"), F.col("spell"), F.col("type")], n)


def run_abilities(events: DataFrame, combat_runs: DataFrame, types, top_n: int = 200) -> DataFrame:
    """Ability table of every run, with label; combat_runs maps combats to run_id."""
    wanted = [types] if isinstance(types, str) else list(types)
    per_combat = (
        events.filter(F.col("type").isin(*wanted) & has_text("spell_name"))
        .groupBy(*COMBAT, F.col("spell_name").alias("spell"))
        .agg(F.sum("effective_amount").alias("t"), F.count("effective_amount").alias("c"))
    )
    keys = ["log_id", "run_id"]
    totals = (
        per_combat.join(combat_runs.select(*COMBAT, "run_id"), COMBAT)
        .groupBy(*keys, "spell")
        .agg(F.sum("c").alias("count"), F.sum("t").alias("total"))
    )
    whole = F.sum("total").over(Window.partitionBy(*keys))
    table = totals.withColumns(
        {
            "avg": ratio("total", "count"),
            "pct": F.when(whole > 0, F.col("total") / whole * 100),
        }
    )
    top = first_rows(table, keys, [F.desc("total"), F.col("spell")], top_n)
    return top.withColumn("label", spell_label("spell", "pct"))


def _timeline_rows(events: DataFrame) -> DataFrame:
    return events.filter(has_text("spell_name") & F.col("type").isin(*TIMELINE_TYPES))


def spell_ranks(events: DataFrame, by: list[str] = COMBAT) -> DataFrame:
    """Abilities of each combat by number of uses: rank 1 is the most used."""
    uses = _timeline_rows(events).groupBy(*by, "spell_name").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy(*by).orderBy(F.desc("uses"), "spell_name")
    return uses.withColumn("spell_rank", F.row_number().over(order))


def combat_starts(events: DataFrame) -> DataFrame:
    return events.groupBy(*COMBAT).agg(
        F.min("ts").alias("start_ts"), span_us(F.min("ts"), F.max("ts")).alias("span_us")
    )


def elapsed_us() -> Column:
    return F.unix_micros("ts") - F.unix_micros("start_ts")


def rotation_timeline(events: DataFrame, top: int | None = 20) -> DataFrame:
    """Events of the most used abilities of each combat, with seconds since its start."""
    ranks = spell_ranks(events)
    if top is not None:
        ranks = ranks.filter(F.col("spell_rank") <= top)
    # The two small tables meet first, so the events are joined once.
    ranks = ranks.drop("uses").join(combat_starts(events).select(*COMBAT, "start_ts"), COMBAT)
    return (
        _timeline_rows(events)
        .join(ranks, [*COMBAT, "spell_name"])
        .select(
            *COMBAT,
            "seq",
            "spell_name",
            "spell_rank",
            seconds(elapsed_us()).alias("elapsed_s"),
            "type",
            "amount",
            "effective_amount",
        )
    )


def ability_uptime(events: DataFrame, top: int = 20) -> DataFrame:
    """Share of whole seconds of a combat in which an ability was active."""
    starts = combat_starts(events)
    used = (
        _timeline_rows(events)
        .filter(F.col("ts").isNotNull())
        .join(starts, COMBAT)
        .select(
            *COMBAT,
            "span_us",
            "spell_name",
            F.floor(elapsed_us() / F.lit(1_000_000)).cast("bigint").alias("second"),
        )
        .groupBy(*COMBAT, "spell_name", "second")
        .agg(F.count(F.lit(1)).alias("uses"), F.first("span_us").alias("span_us"))
        .groupBy(*COMBAT, "spell_name")
        .agg(
            F.count(F.lit(1)).alias("seconds"),
            F.sum("uses").alias("uses"),
            F.first("span_us").alias("span_us"),
        )
    )
    top_used = first_rows(used, COMBAT, [F.desc("uses"), F.col("spell_name")], top)
    whole = F.greatest(F.lit(1), F.ceil(seconds("span_us")).cast("bigint"))
    return top_used.select(
        *COMBAT,
        F.col("spell_name").alias("spell"),
        "uses",
        "seconds",
        (F.col("seconds") / whole * 100).alias("uptime_pct"),
    )
