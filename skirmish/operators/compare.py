"""Comparisons: characters by like encounters, and kills of one boss."""

from __future__ import annotations

from collections import defaultdict, deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.scalars import (
    damage_total,
    has_text,
    healing_total,
    minutes_label,
    ratio,
    run_label,
    seconds,
    short_name,
    span_us,
    target_set_label,
)
from skirmish.operators.kills import kills_to_encounters
from skirmish.operators.metrics import combat_players, in_combat
from skirmish.operators.runs import RUN
from skirmish.operators.spells import first_rows, rotation_timeline, spell_ranks
from skirmish.schemas import COMBAT
from skirmish.session import cut

# Encounters of the reference that one task takes at once.
BLOCK = 4_096
_PAIRED = "comparison string, ref_log_id string, ref_combat_id bigint, character string, log_id string, combat_id bigint"


def fingerprints(
    events: DataFrame,
    characters: list[str] | None = None,
    last_n: int | None = None,
) -> DataFrame:
    """Sorted set of targets of each character's encounters, itself left out.

    last_n keeps the encounters of each character that began last.
    """
    rows = in_combat(events).filter(has_text("source"))
    if characters is not None:
        rows = rows.filter(F.col("source").isin(*characters))
    target = F.when(has_text("target") & (F.col("target") != F.col("source")), F.col("target"))
    sets = rows.groupBy(F.col("source").alias("character"), *COMBAT).agg(
        F.array_sort(F.collect_set(target)).alias("targets"), F.min("ts").alias("_begun")
    )
    return first_rows(sets, ["character"], _newest_first("_begun"), last_n).drop("_begun")


def _newest_first(begun: str) -> list:
    """Newest by time; ids count per log and say nothing over logs."""
    return [F.desc_nulls_last(begun), F.desc("combat_id"), F.desc("log_id")]


def encounter_sequence(
    events: DataFrame, last_n: int | None = None
) -> DataFrame:
    """Encounters of each source with rates, numbered oldest first.

    last_n keeps those that began last.
    """
    begun = in_combat(events).groupBy("source", *COMBAT).agg(F.min("ts").alias("_begun"))
    stats = _source_stats(events).join(begun, ["source", *COMBAT])
    kept = first_rows(stats, ["source"], _newest_first("_begun"), last_n)
    oldest = Window.partitionBy("source").orderBy(F.asc_nulls_first("_begun"), "combat_id", "log_id")
    return kept.withColumn("enc_seq", F.row_number().over(oldest)).drop("_begun")


def _source_stats(events: DataFrame) -> DataFrame:
    spans = in_combat(events).filter(has_text("source")).groupBy("source", *COMBAT).agg(
        seconds(span_us(F.min("ts"), F.max("ts"))).alias("duration_s"),
        damage_total().alias("total_damage"),
        healing_total().alias("total_heal"),
    )
    return spans.withColumns(
        {"dps": ratio("total_damage", "duration_s"), "hps": ratio("total_heal", "duration_s")}
    )


def _reference(prints: DataFrame, characters: list[str]) -> DataFrame:
    """The character with fewest encounters, the first given on ties."""
    given = F.array_position(F.array(*[F.lit(c) for c in characters]), F.col("character"))
    sizes = prints.filter(F.col("character").isin(*characters)).groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.min(F.struct("n", given.alias("p"), "character"))["character"].alias("ref"))


def pair_exact(prints: DataFrame, characters: list[str]) -> DataFrame:
    """Groups of encounters, one of each character, with equal target sets.

    The i-th encounter of a character with some target set pairs with the i-th
    of every other one. The fingerprints are kept as a table, for they are read several times.
    """
    return _pair_exact(cut(prints), characters)


def _pair_exact(prints: DataFrame, characters: list[str]) -> DataFrame:
    order = Window.partitionBy("character", "targets").orderBy("combat_id", "log_id")
    nth = prints.filter(F.col("character").isin(*characters) & (F.size("targets") > 0)).withColumn(
        "nth", F.row_number().over(order)
    )
    complete = (
        nth.groupBy("targets", "nth")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == len(characters))
        .drop("_n")
    )
    ref_name = _reference(prints, characters).scalar()
    ref = nth.filter(F.col("character") == ref_name).select(
        "targets", "nth", F.col("combat_id").alias("ref_combat_id"), F.col("log_id").alias("ref_log_id")
    )
    return (
        nth.join(complete, ["targets", "nth"])
        .join(ref, ["targets", "nth"])
        .select(
            "ref_log_id",
            "ref_combat_id",
            "character",
            *COMBAT,
            target_set_label("targets").alias("label"),
        )
    )


def pair_encounters(prints: DataFrame, characters: list[str], threshold: float = 1.0) -> DataFrame:
    """Groups of encounters whose target sets are alike by Jaccard similarity.

    Encounters of the character with fewest are taken in the order of their ids; each gets the most
    alike encounter of every other character that is still unused, if all of these reach the
    threshold.
    """
    prints = cut(prints)
    if threshold >= 1.0:
        return _pair_exact(prints, characters)
    one = [("", c, place, len(characters)) for place, c in enumerate(characters)]
    comparison = prints.sparkSession.createDataFrame(one, "comparison string, character string, place int, _n int")
    return pair_encounters_each(prints, F.broadcast(comparison), threshold).drop("comparison")


def every_two(prints: DataFrame) -> DataFrame:
    """comparison, character, place, _n: every two characters, the smaller name first."""
    names = prints.select("character").distinct()
    a, b = names.select(F.col("character").alias("a")), names.select(F.col("character").alias("b"))
    both = a.join(b, F.col("a") < F.col("b")).select(F.to_json(F.array("a", "b")).alias("comparison"), F.array("a", "b").alias("_both"))
    return both.select("comparison", F.posexplode("_both").alias("place", "character"), F.lit(2).alias("_n"))


def _references(prints: DataFrame, comparisons: DataFrame) -> DataFrame:
    """comparison, ref: of each comparison the character with fewest encounters, the first on ties."""
    sizes = prints.groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct("n", "place", "character"))["character"]
    return comparisons.join(sizes, "character").groupBy("comparison").agg(least.alias("ref"))


def pair_exact_each(prints: DataFrame, comparisons: DataFrame) -> DataFrame:
    """pair_exact for every comparison of a table (comparison, character, place, _n), in one pass."""
    refs = _references(prints, comparisons)
    order = Window.partitionBy("character", "targets").orderBy("combat_id", "log_id")
    nth = prints.filter(F.size("targets") > 0).withColumn("nth", F.row_number().over(order))
    own = F.max(F.when(F.col("character") == F.col("ref"), F.struct("combat_id", "log_id")))
    groups = (
        nth.join(comparisons, "character")
        .join(refs, "comparison")
        .groupBy("comparison", "targets", "nth", "_n")
        .agg(F.collect_list(F.struct("character", *COMBAT)).alias("_group"), own.alias("_ref"))
        .filter(F.size("_group") == F.col("_n"))
    )
    return groups.select(
        "comparison",
        F.col("_ref.log_id").alias("ref_log_id"),
        F.col("_ref.combat_id").alias("ref_combat_id"),
        F.explode("_group").alias("_one"),
        target_set_label("targets").alias("label"),
    ).select("comparison", "ref_log_id", "ref_combat_id", "_one.*", "label")


def _alike_sets(prints: DataFrame, comparisons: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """comparison, ref_targets, character, targets, similarity: sets of the reference and of another that reach the threshold.

    Equal sets of a character are one row here. Two sets that reach the threshold share one of the first
    targets of each; they meet over the first they share there, once.
    """
    least = F.greatest(F.lit(1), F.ceil(F.size("targets") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    sets = (
        prints.filter(F.size("targets") > 0)
        .select("character", "targets")
        .distinct()
        .withColumn("head", F.slice("targets", F.lit(1), F.size("targets") - least + 1))
        .join(comparisons, "character")
        .join(refs, "comparison")
    )
    flat = sets.withColumn("target", F.explode("head"))
    ref = flat.filter(F.col("character") == F.col("ref")).select(
        "comparison", "target", F.col("targets").alias("ref_targets"), F.col("head").alias("ref_head")
    )
    other = flat.filter(F.col("character") != F.col("ref")).drop("ref", "place", "_n")
    shared = F.size(F.array_intersect("ref_targets", "targets"))
    return (
        ref.join(other, ["comparison", "target"])
        .filter(F.array_min(F.array_intersect("ref_head", "head")) == F.col("target"))
        .withColumn("similarity", shared / (F.size("ref_targets") + F.size("targets") - shared))
        .filter(F.col("similarity") >= threshold)
        .select("comparison", "ref_targets", "character", "targets", "similarity")
    )


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a comparison: its encounters of the reference, the sets alike, and what is left of these sets."""
    n = int(rows["_n"].iloc[0])
    kinds = dict(tuple(rows.groupby("kind")))
    stock: dict[tuple, deque] = defaultdict(deque)
    for r in kinds.get("one", rows[:0]).sort_values(["combat_id", "log_id"]).itertuples(index=False):
        stock[r.character, r.set].append((r.combat_id, r.log_id))
    wanted = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in kinds.get("alike", rows[:0]).itertuples(index=False):
        wanted[r.ref_set][r.character][-r.similarity].append((r.character, r.set))
    chosen = []
    for ref in kinds["ref"].sort_values(["combat_id", "log_id"]).itertuples(index=False):
        group = []
        for levels in wanted[ref.ref_set].values():
            # the most alike sets with anything left, and of these the least encounter
            for level in sorted(levels):
                heads = [(stock[key][0], key) for key in levels[level] if stock[key]]
                if heads:
                    group.append(min(heads))
                    break
        if len(group) == n - 1:
            for one, key in group:
                stock[key].popleft()
                chosen.append((ref.comparison, ref.log_id, ref.combat_id, key[0], one[1], one[0]))
    return pd.DataFrame(chosen, columns=[f.split()[0] for f in _PAIRED.split(", ")])


def pair_encounters_each(
    prints: DataFrame, comparisons: DataFrame, threshold: float, block: int = BLOCK
) -> DataFrame:
    """pair_encounters for every comparison of a table (comparison, character, place, _n), side by side.

    The choice depends on the order of the reference's encounters, so each comparison goes through them
    in blocks of ``block``. A task holds one block of one comparison: its encounters, the target sets
    alike with theirs, and of each such set the first ``block`` encounters not used before, for more cannot
    be taken. Equal sets are compared once.
    """
    refs = cut(_references(prints, comparisons))
    rows = prints.filter(F.size("targets") > 0).join(comparisons, "character").join(refs, "comparison")
    rows = cut(rows.select("comparison", "_n", "character", "ref", "targets", *COMBAT))
    in_order = Window.partitionBy("comparison").orderBy("combat_id", "log_id")
    own = cut(
        rows.filter(F.col("character") == F.col("ref"))
        .withColumn("_block", F.floor((F.row_number().over(in_order) - 1) / block))
        .withColumnRenamed("targets", "ref_targets")
    )
    left = rows.filter(F.col("character") != F.col("ref"))
    alike = cut(_alike_sets(prints, comparisons, refs, threshold))
    matched = None
    for number in range((own.agg(F.max("_block")).first()[0] or 0) + 1):
        now = own.filter(F.col("_block") == number)
        sets = now.select("comparison", "_n", "ref_targets").distinct().join(alike, ["comparison", "ref_targets"])
        used = ["comparison", "character", *COMBAT]
        free = left if matched is None else left.join(matched.select(*used), used, "left_anti")
        first = Window.partitionBy("comparison", "character", "targets").orderBy("combat_id", "log_id")
        free = free.join(sets.select("comparison", "character", "targets"), ["comparison", "character", "targets"], "left_semi")
        free = free.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= block)
        name = F.to_json("targets").alias("set")
        of_ref = F.to_json("ref_targets").alias("ref_set")
        parts = [
            now.select(F.lit("ref").alias("kind"), "comparison", "_n", of_ref, *COMBAT),
            sets.select(F.lit("alike").alias("kind"), "comparison", "_n", of_ref, name, "character", "similarity"),
            free.select(F.lit("one").alias("kind"), "comparison", "_n", name, "character", *COMBAT),
        ]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        # only blocks with an encounter of the reference have anything to choose
        chosen = cut(whole.groupBy("comparison").applyInPandas(_greedy, _PAIRED))
        matched = chosen if matched is None else matched.unionByName(chosen)
    selves = matched.select("comparison", "ref_log_id", "ref_combat_id").distinct().join(refs, "comparison")
    both = matched.unionByName(
        selves.select(
            "comparison",
            "ref_log_id",
            "ref_combat_id",
            F.col("ref").alias("character"),
            F.col("ref_log_id").alias("log_id"),
            F.col("ref_combat_id").alias("combat_id"),
        )
    )
    labels = own.select(
        "comparison",
        F.col("log_id").alias("ref_log_id"),
        F.col("combat_id").alias("ref_combat_id"),
        target_set_label("ref_targets").alias("label"),
    )
    return both.join(labels, ["comparison", "ref_log_id", "ref_combat_id"])


def pair_table_each(pairs: DataFrame) -> DataFrame:
    """One row per group of two, the smaller name first."""
    one = F.struct("character", *COMBAT)
    rows = pairs.groupBy("comparison", "ref_log_id", "ref_combat_id", "label").agg(F.min(one).alias("a"), F.max(one).alias("b"))
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{i}") for i, s in ((1, "a"), (2, "b")) for c in ("character", *COMBAT)]
    return rows.select("comparison", "ref_log_id", "ref_combat_id", "label", *sides)


def paired_metrics(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Rates of every paired encounter, over the time its character was active in it."""
    stats = _source_stats(events).withColumnRenamed("source", "character")
    return pairs.join(stats, ["character", *COMBAT]).select(
        *[c for c in ("comparison",) if c in pairs.columns],
        "ref_log_id",
        "ref_combat_id",
        short_name("character").alias("character"),
        *COMBAT,
        "label",
        "dps",
        "hps",
        "duration_s",
    )


def pair_table(pairs: DataFrame, characters: list[str]) -> DataFrame:
    """One row per group, one combat column per character."""
    return (
        pairs.groupBy("ref_log_id", "ref_combat_id", "label")
        .pivot("character", characters)
        .agg(F.first("combat_id"))
    )


def boss_encounters(
    events: DataFrame, encounters: DataFrame, kills: DataFrame, roles: DataFrame
) -> DataFrame:
    """Encounters matched to a boss kill, with character, role and rates.

    ``encounters`` carry run_id, ``roles`` come from run_roles.
    """
    matched = kills_to_encounters(encounters, kills)
    rows = matched.join(combat_players(events), COMBAT, "left").join(
        roles.select(*RUN, "run_role", "run_spec"), RUN, "left"
    )
    name = F.coalesce("player", F.lit(""))
    fallback = F.concat(F.lit("#"), F.col("combat_id").cast("string"))
    return rows.select(
        "boss_name",
        *COMBAT,
        name.alias("character"),
        F.when(name != "", short_name(name)).otherwise(fallback).alias("character_short"),
        "start_ts",
        "end_ts",
        "duration_s",
        "total_damage",
        "total_heal",
        ratio("total_damage", "duration_s").alias("dps"),
        ratio("total_heal", "duration_s").alias("hps"),
        F.coalesce("run_role", F.lit("DPS")).alias("run_role"),
        F.coalesce("run_spec", F.lit("")).alias("run_spec"),
    )


def boss_list(boss_rows: DataFrame) -> DataFrame:
    return boss_rows.groupBy("boss_name").agg(F.count(F.lit(1)).alias("kills"))


def kill_overview(boss_rows: DataFrame, boss: str | None = None) -> DataFrame:
    """Formatted kills of one boss, or of all."""
    if boss is not None:
        boss_rows = boss_rows.filter(F.col("boss_name") == boss)
    return boss_rows.select(
        "boss_name",
        *COMBAT,
        F.col("character_short").alias("character"),
        F.col("run_role").alias("role"),
        F.col("run_spec").alias("spec"),
        F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("date"),
        minutes_label("duration_s").alias("duration"),
        "dps",
        "hps",
    )


def kill_options(boss_rows: DataFrame) -> DataFrame:
    """Picker labels, newest first; repeats of a label get [1], [2], ..."""
    labelled = boss_rows.withColumn("base", run_label())
    order = Window.partitionBy("boss_name", "base").orderBy(
        F.desc("start_ts"), "combat_id", "log_id"
    )
    repeat = F.row_number().over(order) - 1
    suffix = F.concat(F.lit(" ["), repeat.cast("string"), F.lit("]"))
    return labelled.select(
        "boss_name",
        *COMBAT,
        F.when(repeat == 0, F.col("base")).otherwise(F.concat("base", suffix)).alias("label"),
    )


def combat_delta(boss_rows: DataFrame, left: int | Column, right: int | Column) -> DataFrame:
    """Left minus right: DPS, HPS and duration of two kills of one boss and log."""

    def side(name: str, combat: int | Column) -> DataFrame:
        wanted = combat if isinstance(combat, Column) else F.lit(combat)
        return boss_rows.filter(F.col("combat_id") == wanted).select(
            "log_id",
            "boss_name",
            F.col("combat_id").alias(f"{name}_id"),
            *[F.col(c).alias(f"{name}_{c}") for c in ("dps", "hps", "duration_s")],
        )

    return _delta(side("left", left).join(side("right", right), ["log_id", "boss_name"]))


def _delta(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "log_id",
        "boss_name",
        "left_id",
        "right_id",
        *[
            (F.col(f"left_{c}") - F.col(f"right_{c}")).alias(f"delta_{c}")
            for c in ("dps", "hps", "duration_s")
        ],
    )


def newest_kill_deltas(boss_rows: DataFrame) -> DataFrame:
    """The default comparison of every boss: its newest kill against the one before."""
    order = Window.partitionBy("log_id", "boss_name").orderBy(F.desc("start_ts"), "combat_id")
    before = [F.lead(c).over(order).alias(f"right_{c}") for c in ("dps", "hps", "duration_s")]
    ranked = boss_rows.select(
        "log_id",
        "boss_name",
        F.col("combat_id").alias("left_id"),
        F.lead("combat_id").over(order).alias("right_id"),
        *[F.col(c).alias(f"left_{c}") for c in ("dps", "hps", "duration_s")],
        *before,
        F.row_number().over(order).alias("_rank"),
    )
    return _delta(ranked.filter((F.col("_rank") == 1) & F.col("right_id").isNotNull()))


def _as_id(combat: int | Column) -> Column:
    return combat if isinstance(combat, Column) else F.lit(combat).cast("bigint")


def _two_combats(events: DataFrame, left, right, log_id: str | None) -> tuple[DataFrame, DataFrame]:
    """Events of two combats as a table, and (log_id, combat_id, left, right): which of the two each is.

    The ids may come from queries of their own; they are looked up here and nowhere else, and what
    follows reads two combats, not the events.
    """
    is_left, is_right = F.col("combat_id") == _as_id(left), F.col("combat_id") == _as_id(right)
    rows = events.select("*", is_left.alias("_left"), is_right.alias("_right")).filter("_left OR _right")
    rows = cut(rows if log_id is None else rows.filter(F.col("log_id") == log_id))
    sides = rows.groupBy(*COMBAT).agg(F.max("_left").alias("left"), F.max("_right").alias("right"))
    return rows.drop("_left", "_right"), cut(sides)


def compared_spells(
    events: DataFrame, left: int | Column, right: int | Column, log_id: str | None = None
) -> DataFrame:
    """Abilities of either combat in display order: left by use, then right-only by use."""
    return _display_order(*_two_combats(events, left, right, log_id))


def _display_order(rows: DataFrame, sides: DataFrame) -> DataFrame:
    place = F.struct(F.when(F.col("left"), 0).otherwise(1).alias("side"), "spell_rank")
    places = (
        spell_ranks(rows).join(sides, COMBAT).groupBy("log_id", "spell_name").agg(F.min(place).alias("place"))
    )
    order = Window.partitionBy("log_id").orderBy("place", "spell_name")
    return places.select("log_id", "spell_name", F.row_number().over(order).alias("position"))


def rotation_compare(
    events: DataFrame, left: int | Column, right: int | Column, log_id: str | None = None
) -> DataFrame:
    """Timeline events of both combats, side by side on the same abilities.

    An ability that one side lacks appears there once, as a padding row at
    elapsed -1. Both sides are those of the logs that hold either combat.
    """
    rows, both = _two_combats(events, left, right, log_id)
    spells = cut(_display_order(rows, both))
    names = F.array(F.when(F.col("left"), "Left"), F.when(F.col("right"), "Right"))
    shown_as = both.select(*COMBAT, F.explode(F.array_compact(names)).alias("side"))
    sides = both.select("log_id").distinct().withColumn("side", F.explode(F.array(F.lit("Left"), F.lit("Right"))))
    shown = rotation_timeline(rows, top=None).join(spells, ["log_id", "spell_name"]).join(shown_as, COMBAT)
    columns = ["log_id", "side", "spell_name", "position", "elapsed_s", "type", "effective_amount"]
    present = shown.select("log_id", "side", "spell_name").distinct()
    padding = (
        spells.join(sides, "log_id")
        .join(present, ["log_id", "side", "spell_name"], "left_anti")
        .select(
            "log_id",
            "side",
            "spell_name",
            "position",
            F.lit(-1.0).alias("elapsed_s"),
            F.lit("damage").alias("type"),
            F.lit(0).cast("bigint").alias("effective_amount"),
            F.lit(True).alias("is_padding"),
        )
    )
    return shown.select(*columns, F.lit(False).alias("is_padding")).unionByName(padding)
