"""The driver's tables read as combat data.

These mappings exist for the registered queries and the bench; the operators
know nothing of them. Each expression has the same meaning in the SQL of
``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.scalars import log_time_text
from skirmish.schemas import COMBAT
from skirmish.session import pin_settings

# Hours from the epoch to 2024-01-01, and the same moment in microseconds.
FIRST_HOUR = 473352
FIRST_US = FIRST_HOUR * 3_600_000_000
# Raw lines run this much faster than the events they are made of.
SPEED = 100
SPECS = ["Holy_Priest", "Mistweaver", "Restoration_Druid"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _source() -> Column:
    even = F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string"), F.lit("-Realm-EU"))
    odd = F.concat(F.lit("npc"), (F.col("user_id") % 5).cast("string"))
    return F.when(F.col("user_id") % 2 == 0, even).otherwise(odd)


def _by_type(**values: str) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def combat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as the event table: an hour is a combat, every fifth is none."""
    hour = F.expr(f"unix_micros(ts) div 3600000000 - {FIRST_HOUR} + 1")
    zone = F.dayofmonth("ts") % 4
    healed = F.col("amount") - F.col("amount") % 3
    return _base(spark, sf_dir).select(
        F.lit("main").alias("log_id"),
        F.col("event_id").alias("seq"),
        F.when(hour % 5 == 0, F.lit(0)).otherwise(hour).cast("bigint").alias("combat_id"),
        "ts",
        _by_type(
            click="SPELL_DAMAGE",
            purchase="SPELL_PERIODIC_DAMAGE",
            view="SPELL_HEAL",
            signup="SPELL_ABSORBED",
            error="UNIT_DIED",
        ).alias("event"),
        _source().alias("source"),
        F.when(F.col("k") % 23 == 0, F.lit(""))
        .when(F.col("k") % 11 == 0, F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string"), F.lit("-Realm-EU")))
        .otherwise(F.concat(F.lit("T"), (F.col("k") % 9).cast("string")))
        .alias("target"),
        F.concat(F.lit("S"), (F.col("k") % 17).cast("string")).alias("spell_name"),
        "amount",
        F.when(F.col("event_type") == "view", healed).otherwise(F.col("amount")).alias("effective_amount"),
        _by_type(click="damage", purchase="damage", view="heal", signup="absorb", error="other").alias("type"),
        zone.cast("int").alias("zone_id"),
        F.when(zone == 0, F.lit("")).otherwise(F.concat(F.lit("Zone"), zone.cast("string"))).alias("zone_name"),
        F.col("k").alias("spell_id"),
    )


def combat_kills(events: DataFrame) -> DataFrame:
    """A kill at, or some seconds after, the end of every seventh combat."""
    seventh = events.filter((F.col("combat_id") > 0) & (F.col("combat_id") % 7 == 0))
    late = F.col("combat_id") % 30 * 1_000_000
    rows = seventh.groupBy(*COMBAT).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("_last"), F.max("zone_id").alias("_zone")
    )
    return rows.select(
        "log_id",
        F.col("combat_id").alias("seq"),
        F.concat(F.lit("Boss"), (F.col("combat_id") % 5).cast("string")).alias("boss_name"),
        "start_ts",
        F.timestamp_micros(F.unix_micros("_last") + late).alias("end_ts"),
        F.when(F.col("combat_id") % 21 == 0, 0).otherwise(1).alias("kill_flag"),
        F.when(F.col("combat_id") % 4 == 1, 0).otherwise(F.col("_zone")).alias("zone_id"),
    )


def healer_spells(events: DataFrame) -> DataFrame:
    """Every 29th spell id heals, for a spec by turns; so does S16, by name."""
    by_id = events.select("spell_id").distinct().filter("spell_id > 0 and spell_id % 29 = 0")
    spec = F.get(F.array(*[F.lit(s) for s in SPECS]), (F.expr("spell_id div 29") % 3).cast("int"))
    by_name = events.select("spell_name").distinct().filter("spell_name = 'S16'")
    return by_id.select(spec.alias("spec"), "spell_id", F.lit(None).cast("string").alias("spell_name")).unionByName(
        by_name.select(
            F.lit("Discipline_Priest").alias("spec"),
            F.lit(None).cast("bigint").alias("spell_id"),
            F.lower("spell_name").alias("spell_name"),
        )
    )


def combat_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as combats, their line items as events; the wide table of the bench."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.lit("orders").alias("log_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_orderkey") + 1).alias("combat_id"),
        F.timestamp_micros(
            F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("l_linenumber") * 1_000_000
        ).alias("ts"),
        F.lit("SPELL_DAMAGE").alias("event"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"),
        F.concat(F.lit("F"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("spell_name"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
        F.round(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount"))).cast("bigint").alias("effective_amount"),
        F.when(F.col("l_returnflag") == "A", "absorb")
        .when(F.col("l_returnflag") == "R", "heal")
        .otherwise("damage")
        .alias("type"),
        (F.col("o_custkey") % 4).cast("int").alias("zone_id"),
        F.concat(F.lit("Zone"), (F.col("o_custkey") % 4).cast("string")).alias("zone_name"),
        F.col("l_linenumber").cast("bigint").alias("spell_id"),
    )


# Flags of the made-up units: the owner, a party member, an enemy.
OWNER, MATE, ENEMY = "0x511", "0x512", "0x10a48"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet written as log text of three logs, a hundred times as fast.

    click: owner or mate hits an enemy with a spell; purchase: melee, either
    way; view: heal; signup: absorb in one of two layouts; error: deaths, zone
    changes, boss markers and a malformed line.
    """
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")

    def text(c) -> Column:
        return c.cast("string")

    us = F.lit(FIRST_US) + F.expr(f"(unix_micros(ts) - {FIRST_US}) div {SPEED}")
    player = F.concat(F.lit("Player-1-"), text(user % 7))
    player_name = F.concat(F.lit('"P'), text(user % 7), F.lit('-Realm-EU"'))
    enemy = F.concat(F.lit("Creature-0-"), text(F.expr("event_id div 60")), F.lit("-"), text(k % 5))
    enemy_name = F.concat(F.lit('"T'), text(k % 9), F.lit(', the Odd"'))
    own_flags = F.when(user % 5 == 0, MATE).otherwise(OWNER)
    spell = F.concat_ws(",", text(k), F.concat(F.lit('"S'), text(k % 17), F.lit('"')), F.lit("0x1"))
    unit_player = F.concat_ws(",", player, player_name, own_flags, F.lit("0x0"))
    unit_enemy = F.concat_ws(",", enemy, enemy_name, F.lit(ENEMY), F.lit("0x0"))
    amount = text(F.col("amount"))
    x = F.format_string("%.2f", F.lit(100.0) + k)
    y = F.format_string("%.2f", F.lit(-200.0) - user % 50)

    spell_hit = F.concat_ws(
        ",", F.lit("SPELL_DAMAGE"), unit_player, unit_enemy, spell, amount,
        F.lit("-1,0"), x, y, F.lit("0,nil,nil,nil,nil,nil"),
    )
    to_enemy = F.concat_ws(",", unit_player, unit_enemy)
    to_player = F.concat_ws(",", unit_enemy, unit_player)
    swing = F.concat_ws(
        ",", F.lit("SWING_DAMAGE"), F.when(k % 2 == 0, to_enemy).otherwise(to_player), amount,
        F.lit("-1,0,0,nil,nil,nil,nil"),
    )
    heal = F.concat_ws(
        ",", F.lit("SPELL_HEAL"), unit_player, unit_player, spell, amount, amount,
        text(F.col("amount") % 3), F.lit("0,nil"),
    )
    shield = F.concat_ws(
        ",", unit_player, F.lit("77"), F.concat(F.lit('"Ward, S'), text(k % 17), F.lit('"')), F.lit("0x2"),
        amount, F.lit("0,nil"),
    )
    absorb = F.concat_ws(
        ",", F.lit("SPELL_ABSORBED"), to_player, F.when(k % 2 == 0, spell), shield
    )
    zone = F.when(k % 20 == 0, F.lit("UNKNOWN AREA")).otherwise(F.concat(F.lit("Zone"), text(user % 4)))
    zone_change = F.concat(F.lit("ZONE_CHANGE,"), text(user % 4), F.lit(',"'), zone, F.lit('",0'))
    boss = F.concat(F.lit(',"Boss'), text(user % 5), F.lit('",16,5,'))
    starts = F.concat(F.lit("ENCOUNTER_START,"), text(k), boss, text(user % 4))
    ends = F.concat(F.lit("ENCOUNTER_END,"), text(k), boss, text(user % 2), F.lit(",9000"))
    nobody = F.lit("0000000000000000,nil,0x80000000,0x80000000")
    player_dies = F.concat_ws(",", F.lit("UNIT_DIED"), nobody, unit_player)
    enemy_dies = F.concat_ws(",", F.lit("UNIT_DIED"), nobody, unit_enemy)
    error = (
        F.when(k % 10 == 0, zone_change)
        .when(k % 10 == 1, starts)
        .when(k % 10 == 2, ends)
        .when(k % 10 == 3, player_dies)
        .when(k % 10 == 4, F.lit("NOFIELDS"))
        .otherwise(enemy_dies)
    )
    body = (
        F.when(F.col("event_type") == "click", spell_hit)
        .when(F.col("event_type") == "purchase", swing)
        .when(F.col("event_type") == "view", heal)
        .when(F.col("event_type") == "signup", absorb)
        .otherwise(error)
    )
    return _base(spark, sf_dir).select(
        F.concat(F.lit("log"), text(user % 3)).alias("log_id"),
        event.alias("seq"),
        F.concat(log_time_text(F.timestamp_micros(us)), F.lit("  "), body).alias("value"),
    )
