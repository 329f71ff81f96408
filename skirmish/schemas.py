"""Explicit schemas; nothing in this package infers one."""

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("combat_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("spell_name", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("effective_amount", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("zone_name", T.StringType()),
        T.StructField("spell_id", T.LongType()),
    ]
)

BOSS_KILLS_JSON = T.StructType(
    [
        T.StructField("boss_name", T.StringType()),
        T.StructField("start_ts", T.StringType()),
        T.StructField("end_ts", T.StringType()),
        T.StructField("kill_flag", T.IntegerType()),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("log_id", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

NOTES = T.StructType(
    [T.StructField("combat_id", T.LongType()), T.StructField("note", T.StringType())]
)

STORED_NOTES = T.StructType([T.StructField("log_id", T.StringType()), *NOTES.fields])
STORED_HIDDEN = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("combat_id", T.LongType())])

RAW_LINES = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

# Encounters of imported and followed logs; batch names the writer and its micro-batch.
ENCOUNTERS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("combat_id", T.LongType()),
        T.StructField("open_seq", T.LongType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("enemy_guids", T.ArrayType(T.StringType())),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("zone_name", T.StringType()),
        T.StructField("close_reason", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)

BOSS_KILLS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("boss_name", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("kill_flag", T.IntegerType()),
        T.StructField("zone_id", T.IntegerType()),
    ]
)

# What the list of recent encounters shows of each.
TOTALS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("combat_id", T.LongType()),
        T.StructField("begun_ts", T.TimestampType()),
        T.StructField("player", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("total_damage", T.LongType()),
        T.StructField("total_heal", T.LongType()),
    ]
)

# One encounter within one log.
COMBAT = ["log_id", "combat_id"]
