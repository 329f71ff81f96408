"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skirmish import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator, 0.0 where the denominator is not positive."""
    n, d = col(numerator), col(denominator)
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def span_us(start: str | Column, end: str | Column) -> Column:
    """Microseconds from start to end, never negative, 0 where either is missing."""
    gap = F.unix_micros(col(end)) - F.unix_micros(col(start))
    return F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("bigint")


def seconds(micros: str | Column) -> Column:
    return col(micros) / F.lit(1e6)


def is_damage() -> Column:
    return F.col("type") == "damage"


def is_healing() -> Column:
    return F.col("type").isin(*fixed.HEALING_TYPES)


def sum_where(condition: Column, value: str | Column = "effective_amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0)).cast("bigint")


def damage_total() -> Column:
    return sum_where(is_damage())


def healing_total() -> Column:
    return sum_where(is_healing())


def has_text(c: str | Column) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def known_zone() -> Column:
    return has_text("zone_name") & (F.col("zone_name") != fixed.UNKNOWN_ZONE)


def short_name(c: str | Column) -> Column:
    return F.substring_index(col(c), "-", 1)


def is_player_name(c: str | Column) -> Column:
    """Name-Realm-Region: exactly three parts, none empty."""
    parts = F.split(F.trim(col(c)), "-")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: p != "")


def minutes_label(secs: str | Column) -> Column:
    """M:SS"""
    s = F.floor(col(secs)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), s % 60)


def bracket_label(secs: str | Column) -> Column:
    """[MM:SS], empty for no duration."""
    s = F.floor(col(secs)).cast("bigint")
    text = F.format_string("[%02d:%02d]", F.floor(s / 60).cast("bigint"), s % 60)
    return F.when(col(secs) > 0, text).otherwise(F.lit(""))


def played_label(secs: str | Column) -> Column:
    """Xh Ym from an hour up, Xm Ys below."""
    s = F.floor(col(secs)).cast("bigint")
    hours = F.format_string(
        "%dh %dm", F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint")
    )
    minutes = F.format_string("%dm %ds", F.floor(s / 60).cast("bigint"), s % 60)
    return F.when(s >= 3600, hours).otherwise(minutes)


def compact_amount(amount: str | Column, html: bool = False) -> Column:
    """152 K, 3 M; halves round to the even neighbour."""
    v = col(amount).cast("double")
    unit = "&nbsp;<strong>%s</strong>" if html else " %s"

    def scaled(by: float) -> Column:
        return F.bround(v / F.lit(by), 0).cast("bigint").cast("string")

    return (
        F.when(v >= 1_000_000, F.concat(scaled(1e6), F.lit(unit % "M")))
        .when(v >= 1000, F.concat(scaled(1e3), F.lit(unit % "K")))
        .otherwise(F.coalesce(scaled(1.0), F.lit("0")))
    )


def class_of_spec(spec: str | Column) -> Column:
    pairs = [F.lit(x) for item in fixed.SPEC_CLASS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(spec)), F.lit(""))


def target_set_label(targets: str | Column, shown: int = 4) -> Column:
    """First names of a sorted target set, then how many more."""
    t = col(targets)
    head = F.array_join(F.slice(t, 1, shown), ", ")
    more = F.concat(F.lit(" +"), (F.size(t) - shown).cast("string"))
    return F.when(F.size(t) > shown, F.concat(head, more)).otherwise(head)


def spell_label(spell: str | Column, pct: str | Column) -> Column:
    return F.concat(col(spell), F.lit(" » "), F.format_string("%4.1f%%", col(pct)))


def run_label() -> Column:
    """Picker text of a boss kill: character, role, date, duration, stronger rate."""
    stronger = F.when(
        F.col("dps") > F.col("hps"), F.concat(F.lit("DPS "), compact_amount("dps"))
    ).otherwise(F.concat(F.lit("HPS "), compact_amount("hps")))
    who = F.concat(F.col("character_short"), F.lit(" ("), F.col("run_role"), F.lit(")"))
    date = F.coalesce(F.date_format("start_ts", "MM/dd HH:mm"), F.lit("?"))
    return F.concat_ws(" — ", who, date, minutes_label("duration_s"), stronger)


def log_time(text: str | Column) -> Column:
    """Log timestamp with one to six fraction digits; anything else is null."""
    return F.try_to_timestamp(col(text), F.lit(fixed.TIMESTAMP_FORMAT))


def log_time_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "MM/dd/yyyy HH:mm:ss.SSSSSS")
