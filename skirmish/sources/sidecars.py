"""Small side files: healer spells, hidden encounters, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish import schemas
from skirmish.schemas import COMBAT
from skirmish.sources import manifest
from skirmish.sources.tables import path_exists


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.option("wholetext", True).text(path)


def read_healer_spells(spark: SparkSession, path: str) -> DataFrame:
    """(spec, spell_id, spell_name) from {"spec": [id or name, ...]}.

    An entry that is a whole number is an id, any other one a name. A missing
    or malformed file is empty.
    """
    specs = F.from_json("value", "map<string,array<string>>")
    entries = (
        _whole_text(spark, path)
        .select(F.explode(specs).alias("spec", "entries"))
        .select("spec", F.explode("entries").alias("entry"))
    )
    number = F.when(
        F.regexp_like("entry", F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.col("entry").try_cast("bigint")
    )
    return entries.select(
        "spec", number.alias("spell_id"), F.when(number.isNull(), F.col("entry")).alias("spell_name")
    )


def _named(df: DataFrame, log_id: str | None) -> DataFrame:
    """Ids count per log: the log a side file belongs to, if it is given."""
    return df if log_id is None else df.select(F.lit(log_id).alias("log_id"), *df.columns)


def _keys(*tables: DataFrame) -> list[str]:
    """An encounter's key as far as all tables name it."""
    return [c for c in COMBAT if all(c in t.columns for t in tables)]


def read_hidden(spark: SparkSession, path: str, log_id: str | None = None) -> DataFrame:
    """Hidden combat ids from a JSON array; empty if missing or malformed."""
    ids = F.from_json("value", "array<bigint>")
    found = (
        _whole_text(spark, path)
        .select(F.explode(ids).alias("combat_id"))
        .filter(F.col("combat_id").isNotNull())
        .distinct()
    )
    return _named(found, log_id)


def toggle_hidden(hidden: DataFrame, combat_ids: DataFrame) -> DataFrame:
    """Encounters in exactly one of the two tables, by log_id where both have it."""
    keys = _keys(hidden, combat_ids)
    left = hidden.select(*keys).distinct().withColumn("_was", F.lit(True))
    right = combat_ids.select(*keys).distinct().withColumn("_flip", F.lit(True))
    both = left.join(right, keys, "full_outer")
    return both.filter(F.col("_was").isNull() | F.col("_flip").isNull()).select(*keys)


def write_hidden(hidden: DataFrame, path: str) -> None:
    """A JSON array of the ids in order, as text; ids are a hand-made selection."""
    ids = hidden.agg(F.array_sort(F.collect_set("combat_id")).alias("ids"))
    ids.select(F.to_json("ids").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_notes(spark: SparkSession, path: str, log_id: str | None = None) -> DataFrame:
    """(combat_id, note); the last line of a combat counts, bad lines do not."""
    if not path_exists(spark, path):
        return _named(spark.createDataFrame([], schemas.NOTES), log_id)
    lines = spark.read.schema(schemas.NOTES).option("mode", "DROPMALFORMED").json(path)
    # Files in the order of their names, lines as they stand.
    lines = lines.select("*", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.filter(F.col("combat_id").isNotNull()).withColumn(
        "_line", F.monotonically_increasing_id()
    )
    last = Window.partitionBy("combat_id").orderBy(
        F.desc("file_path"), F.desc("file_block_start"), F.desc("_line")
    )
    found = (
        lines.withColumn("_rank", F.row_number().over(last))
        .filter("_rank = 1")
        .select("combat_id", F.coalesce("note", F.lit("")).alias("note"))
    )
    return _named(found, log_id)


def upsert_note(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with the changes in place; an empty note removes the entry."""
    keys = _keys(notes, changes)
    kept = notes.join(changes.select(*keys), keys, "left_anti")
    fresh = changes.filter(F.col("note").isNotNull() & (F.col("note") != ""))
    return kept.select(*keys, "note").unionByName(fresh.select(*keys, "note")).orderBy(*keys)


def write_notes(notes: DataFrame, path: str) -> None:
    notes.orderBy("combat_id").write.mode("overwrite").json(path)


# --- kept in place ------------------------------------------------------------------------------


def stored_notes(spark: SparkSession, path: str, seen: manifest.State | None = None) -> DataFrame:
    """(log_id, combat_id, note) of a note table that is changed in place."""
    return manifest.read_committed(spark, path, "notes", schemas.STORED_NOTES, seen)


def stored_hidden(spark: SparkSession, path: str, seen: manifest.State | None = None) -> DataFrame:
    """(log_id, combat_id) of a table of hidden encounters that is changed in place."""
    return manifest.read_committed(spark, path, "hidden", schemas.STORED_HIDDEN, seen)


def change_notes(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Apply changes (log_id, combat_id, note) to the table they are read from.

    A version is written beside the old one and takes its place by one commit; who reads meanwhile sees
    the old one whole. If another writer was faster the changes are applied to what it wrote.
    """
    _change(spark, path, "notes", lambda seen: upsert_note(stored_notes(spark, path, seen), changes), schemas.STORED_NOTES)


def toggle_stored(spark: SparkSession, path: str, combat_ids: DataFrame) -> None:
    """Hide what is shown and show what is hidden, in place, for (log_id, combat_id); see change_notes."""
    _change(
        spark, path, "hidden", lambda seen: toggle_hidden(stored_hidden(spark, path, seen), combat_ids), schemas.STORED_HIDDEN
    )


def _change(spark: SparkSession, path: str, name: str, apply, schema) -> None:
    while True:
        seen = manifest.state(spark, path)
        rows = apply(seen).select(*schema.fieldNames()).coalesce(1)
        if manifest.try_commit(spark, path, seen, {name: [manifest.add_folder(rows, path, name)]}, [name]):
            return
