"""Log text to typed rows, all in built-in expressions.

Every parser takes lines(log_id, seq, value) and first drops, by a cheap test
on the short text before the first comma, the lines it has no use for; only
the rest is cut into fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish import fixed
from skirmish.functions.scalars import log_time

# One field after its comma: quoted (doubled quotes inside) or plain.
_FIELD = r""",("[^"]*+(?:""[^"]*+)*+"?+[^,]*|[^,]*)"""
_NO_QUOTED_COMMA = r"""^(?:[^"]++|"[^",]*+")*+$"""


def _once(df: DataFrame, value: Column, name: str, keep: list[str]) -> DataFrame:
    """Add a column that is worked out once per row.

    A filter on a plain projected column moves below the projection and repeats
    the column's expression there. A generator keeps such filters above it.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _headers(lines: DataFrame, strip_line: bool = False) -> DataFrame:
    """Split at the first comma, then the part before it at its last blank run."""
    value = F.trim(F.col("value")) if strip_line else F.col("value")
    comma = F.instr(value, ",")
    header = F.trim(F.translate(F.substring_index(value, ",", 1), "\t\r\f\v", "    "))
    split = F.struct(header.alias("header"), F.substr(value, comma + 1).alias("fields"))
    rows = _once(lines.filter(comma > 0), split, "_line", ["log_id", "seq"])
    event = F.substring_index("_line.header", " ", -1)
    split = F.struct("_line.header", event.alias("event"), "_line.fields")
    rows = _once(rows, split, "_line", ["log_id", "seq"])
    time_length = F.length("_line.header") - F.length("_line.event")
    return rows.filter(time_length > 0).select(
        "log_id",
        "seq",
        F.rtrim(F.substr(F.col("_line.header"), F.lit(1), time_length)).alias("ts_text"),
        F.col("_line.event").alias("event"),
        F.col("_line.fields").alias("_fields"),
    )


def _tokens(headers: DataFrame) -> DataFrame:
    """Fields after the first comma; quotes are dropped from every field.

    Lines without a comma inside quotes, nearly all, are split at commas; only
    the others are matched field by field.
    """
    mark = "\u0002"
    plain = F.split(F.replace("_fields", F.lit('"'), F.lit("")), ",")
    fields = F.regexp_extract_all(F.concat(F.lit(","), "_fields"), F.lit(_FIELD), F.lit(1))
    quoted = F.split(F.replace(F.array_join(fields, mark), F.lit('"'), F.lit("")), mark)
    parts = F.when(F.regexp_like("_fields", F.lit(_NO_QUOTED_COMMA)), plain).otherwise(quoted)
    return _once(headers, parts, "parts", [c for c in headers.columns if c != "_fields"])


def _timed(headers: DataFrame) -> DataFrame:
    """Header rows with a valid time, as ts."""
    keep = [c for c in headers.columns if c != "ts_text"]
    return _once(headers, log_time("ts_text"), "ts", keep).filter(F.col("ts").isNotNull())


def part(index: int) -> Column:
    """Field by position from 0; negative counts from the end; null if absent."""
    return F.try_element_at("parts", F.lit(index + 1 if index >= 0 else index))


def integer(text: Column) -> Column:
    """Whole number, 0 for anything else."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


_HEX = r"^\s*(?:0[xX])?[0-9a-fA-F]+\s*$"


def is_hex(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(_HEX)), F.lit(False))


def flags(text: Column) -> Column:
    """Hexadecimal flag field, with or without 0x; 0 for anything else."""
    digits = F.replace(F.lower(F.trim(text)), F.lit("0x"), F.lit(""))
    return F.coalesce(F.when(is_hex(text), F.conv(digits, 16, 10).try_cast("bigint")), F.lit(0))


def has_flags(flag_column: str | Column, mask: int) -> Column:
    """Any bit of the mask set."""
    c = F.col(flag_column) if isinstance(flag_column, str) else flag_column
    return c.bitwiseAND(F.lit(mask)) != 0


def is_mine(flag_column: str) -> Column:
    return has_flags(flag_column, fixed.FLAG_MINE)


def is_active_player(flag_column: str | Column) -> Column:
    c = F.col(flag_column) if isinstance(flag_column, str) else flag_column
    mask = F.lit(fixed.FLAG_ACTIVE_PLAYER)
    return c.bitwiseAND(mask) == mask


def is_enemy(flag_column: str) -> Column:
    """An NPC that is neither friendly nor controlled by the group."""
    allied = fixed.FLAG_MINE | fixed.FLAG_PARTY | fixed.FLAG_RAID
    return (
        has_flags(flag_column, fixed.FLAG_NPC)
        & ~has_flags(flag_column, fixed.FLAG_FRIENDLY)
        & ~has_flags(flag_column, allied)
    )


def is_friendly(flag_column: str) -> Column:
    return has_flags(flag_column, fixed.FLAG_MINE | fixed.FLAG_PARTY)


def parse_raw_events(lines: DataFrame, events: tuple[str, ...] | None = None) -> DataFrame:
    """Header fields of every well-formed event line.

    ``events`` keeps only lines of these events, before fields are cut.
    """
    heads = _headers(lines)
    if events is not None:
        heads = heads.filter(F.col("event").isin(*events))
    rows = _tokens(_timed(heads)).filter(F.size("parts") >= 8)
    fields = F.struct(
        part(0).alias("src_guid"),
        part(1).alias("src_name"),
        flags(part(2)).alias("src_flags"),
        part(4).alias("dst_guid"),
        part(5).alias("dst_name"),
        flags(part(6)).alias("dst_flags"),
    )
    return _once(rows, fields, "f", ["log_id", "seq", "ts", "event", "parts"]).select(
        "log_id", "seq", "ts", "event", "f.*", "parts"
    )


def event_parts(lines: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """log_id, seq, event, ts, parts of the lines of these events."""
    return _tokens(_timed(_headers(lines).filter(F.col("event").isin(*events))))


def _spell_layout() -> Column:
    """An absorb row names the absorbed spell, in three more fields, if field 8 is a number."""
    return F.coalesce(F.substr(part(8), F.lit(1), F.lit(1)).between("0", "9"), F.lit(False))


def _layout(spell_index: int, swing_index: int) -> Column:
    """What a row is, and where (counted from 1) its fields stand."""
    event, width = F.col("event"), F.size("parts")
    absorb = (event == "SPELL_ABSORBED") & (width >= 18)
    shift = F.when(_spell_layout(), 3).otherwise(0)
    kind = (
        F.when(absorb, "absorb")
        .when(event.contains("HEAL") & (width >= 10), "heal")
        .when(event.contains("DAMAGE") & event.contains("SPELL") & (width >= 10), "damage")
        .when(event == "SWING_DAMAGE", "melee")
    )

    def from_end(index: int) -> Column:
        return F.when(width >= -index, F.lit(index)).otherwise(-1)

    amount_at = (
        F.when(absorb, shift + 16)
        .when(event.contains("HEAL"), -5)
        .when(event == "SWING_DAMAGE", from_end(swing_index))
        .otherwise(from_end(spell_index))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(absorb, shift + 10).otherwise(2).alias("source_at"),
        F.when(absorb, shift + 11).otherwise(3).alias("flags_at"),
        F.when(absorb, shift + 14).otherwise(10).alias("spell_at"),
        amount_at.alias("amount_at"),
        # An absorb row without a layout mark, or too short for its layout, is dropped.
        (~absorb | ((part(8) != "") & ((shift == 0) | (width >= 21)))).alias("complete"),
    )


def parse_player_events(
    lines: DataFrame, spell_index: int = -11, swing_index: int = -8
) -> DataFrame:
    """Damage, healing and absorbs done by the log owner or the owner's units.

    ``spell_index`` and ``swing_index`` are where the amount of spell and of
    melee damage stands, counted from the end.
    """
    event, kind = F.col("event"), F.col("at.kind")
    wanted = (
        event.contains("HEAL")
        | (event.contains("DAMAGE") & event.contains("SPELL"))
        | event.isin("SWING_DAMAGE", "SPELL_ABSORBED")
    )
    keep = ["log_id", "seq", "ts_text", "event", "parts"]

    def at(place: str) -> Column:
        return F.try_element_at("parts", F.col(f"at.{place}"))

    rows = _tokens(_headers(lines, strip_line=True).filter(wanted))
    rows = rows.filter((F.size("parts") >= 3) & is_hex(part(2)))
    rows = _once(rows, _layout(spell_index, swing_index), "at", keep)
    rows = rows.filter(kind.isNotNull() & F.col("at.complete"))
    rows = _once(rows, flags(at("flags_at")), "owner_flags", [*keep, "at"]).filter(is_mine("owner_flags"))
    rows = _once(rows, integer(at("amount_at")), "amount", [*keep, "at", "owner_flags"])
    by_id = kind.isin("heal", "damage") & F.regexp_like(part(8), F.lit("^[0-9]+$"))
    healed = F.greatest(F.lit(0), F.col("amount") - integer(part(-3)))
    return rows.select(
        "log_id",
        "seq",
        log_time("ts_text").alias("ts"),
        "event",
        at("source_at").alias("source"),
        F.coalesce(part(5), F.lit("")).alias("target"),
        F.when(kind == "melee", "Melee").otherwise(at("spell_at")).alias("spell_name"),
        "amount",
        F.when(kind == "heal", healed).otherwise(F.col("amount")).alias("effective_amount"),
        F.when(kind == "melee", "damage").otherwise(kind).alias("type"),
        F.coalesce(F.when(by_id, part(8).try_cast("bigint")), F.lit(0)).cast("bigint").alias("spell_id"),
        is_active_player("owner_flags").alias("by_active_player"),
    )


def unreadable_absorbs(lines: DataFrame) -> DataFrame:
    """Per log: absorb rows that parse_player_events drops for want of a layout mark."""
    rows = _tokens(_headers(lines, strip_line=True).filter(F.col("event") == "SPELL_ABSORBED"))
    bad = rows.filter((F.size("parts") >= 18) & is_hex(part(2)) & (part(8) == ""))
    return bad.groupBy("log_id").agg(F.count(F.lit(1)).alias("dropped"))


def active_character(lines: DataFrame) -> DataFrame:
    """Per log: the first active player that acts, by line order."""
    width = F.size("parts")
    absorb = (F.col("event") == "SPELL_ABSORBED") & (width >= F.when(_spell_layout(), 21).otherwise(18))
    shift = F.when(_spell_layout(), 3).otherwise(0)
    rows = _tokens(_headers(lines, strip_line=True)).filter((width >= 3) & is_hex(part(2)))
    owner = flags(part(2))
    caster = flags(F.try_element_at("parts", shift + 11))
    name = F.when(is_active_player(owner), part(1)).when(
        absorb & (part(8) != "") & is_active_player(caster), F.try_element_at("parts", shift + 10)
    )
    named = _once(rows, name, "name", ["log_id", "seq"]).filter(F.col("name").isNotNull())
    return named.groupBy("log_id").agg(F.min_by("name", "seq").alias("active_character"))


def log_summary(parsed: DataFrame) -> DataFrame:
    """Per log: totals, duration from first to last line in file order, rates."""
    healing = F.when(F.col("type") == "damage", 0).otherwise(F.col("effective_amount"))
    timed = F.when(F.col("ts").isNotNull(), F.col("seq"))
    totals = parsed.groupBy("log_id").agg(
        F.sum(F.when(F.col("type") == "damage", F.col("effective_amount")).otherwise(0)).alias("total_damage"),
        F.sum(healing).alias("total_heal"),
        F.min_by("ts", timed).alias("first_ts"),
        F.max_by("ts", timed).alias("last_ts"),
    )
    gap = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    duration = F.when(F.coalesce(gap, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(gap)
    return totals.withColumn("duration_s", duration).select(
        "log_id",
        "total_damage",
        "total_heal",
        "duration_s",
        (F.col("total_damage") / F.col("duration_s")).alias("avg_dps"),
        (F.col("total_heal") / F.col("duration_s")).alias("avg_hps"),
    )


def parse_zone_changes(lines: DataFrame) -> DataFrame:
    heads = _headers(lines.filter(F.col("value").contains("ZONE_CHANGE")))
    heads = _timed(heads.filter(F.col("event") == "ZONE_CHANGE"))
    rows = _tokens(heads).filter(F.size("parts") >= 2)
    return rows.select(
        "log_id", "seq", "ts", integer(part(0)).cast("int").alias("zone_id"), part(1).alias("zone_name")
    )


def parse_boss_markers(lines: DataFrame) -> DataFrame:
    """Scripted encounter markers: marker START with a zone, END with a kill flag."""
    maybe = F.col("value").contains("ENCOUNTER_START") | F.col("value").contains("ENCOUNTER_END")
    heads = _headers(lines.filter(maybe))
    heads = heads.filter(F.col("event").isin("ENCOUNTER_START", "ENCOUNTER_END"))
    rows = _tokens(_timed(heads))
    starts = F.col("event") == "ENCOUNTER_START"
    fifth = integer(part(4)).cast("int")
    return rows.select(
        "log_id",
        "seq",
        "ts",
        F.when(starts, "START").otherwise("END").alias("marker"),
        F.coalesce(part(1), F.lit("Unknown")).alias("boss_name"),
        F.when(starts, fifth).alias("zone_id"),
        F.when(~starts, fifth).alias("kill_flag"),
    )
