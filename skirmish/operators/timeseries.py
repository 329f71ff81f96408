"""Bucketed series, smoothing, trends, and cumulative frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.scalars import (
    damage_total,
    healing_total,
    is_damage,
    is_healing,
    seconds,
    sum_where,
)
from skirmish.operators.scans import running, seq_block
from skirmish.operators.spells import combat_starts, elapsed_us, first_rows
from skirmish.schemas import COMBAT


def _bucket_us(step_s: int) -> Column:
    step = F.lit(step_s * 1_000_000)
    return (F.floor(F.unix_micros("ts") / step) * step).cast("bigint")


def time_series(
    events: DataFrame, step_s: int = 2, spell: str | None = None, kind: str | None = None
) -> DataFrame:
    """Damage and healing per bucket of every combat, empty buckets as 0.

    Buckets run from the first to the last damage event and from the first to
    the last healing event; a hole between the two stretches stays a hole. The
    values are sums of a bucket, not divided by its width. A ``spell`` adds the
    sums of that spell, of one ``kind`` ("damage" or "healing") or of both.
    """
    chosen = F.col("spell_name") == F.lit(spell)
    none = F.lit(0).cast("bigint")
    selected = {} if spell is None else {
        "selected_dps": none if kind == "healing" else sum_where(chosen & is_damage()),
        "selected_hps": none if kind == "damage" else sum_where(chosen & is_healing()),
    }
    rows = events.filter((is_damage() | is_healing()) & F.col("ts").isNotNull())
    sums = rows.groupBy(*COMBAT, _bucket_us(step_s).alias("bucket")).agg(
        damage_total().alias("dps"),
        healing_total().alias("hps"),
        F.max(is_damage()).alias("has_damage"),
        F.max(is_healing()).alias("has_healing"),
        *[F.max(F.lit(0)).cast("bigint").alias(n) if c is none else c.alias(n) for n, c in selected.items()],
    )
    # Fill the gap to the next bucket where a stretch of one side spans it.
    order = Window.partitionBy(*COMBAT).orderBy("bucket")
    whole = Window.partitionBy(*COMBAT)
    following = F.lead("bucket").over(order)

    def spanned(flag: str) -> Column:
        at = F.when(F.col(flag), F.col("bucket"))
        return (F.min(at).over(whole) <= F.col("bucket")) & (F.max(at).over(whole) >= following)

    step = step_s * 1_000_000
    filled = F.when(
        spanned("has_damage") | spanned("has_healing"),
        F.sequence(F.col("bucket"), following - step, F.lit(step).cast("bigint")),
    ).otherwise(F.array("bucket"))
    values = ["dps", "hps", *selected]
    spread = sums.withColumn("_filled", filled).select(
        *COMBAT, "bucket", F.explode("_filled").alias("_at"), *values
    )
    return spread.select(
        *COMBAT,
        F.timestamp_micros("_at").alias("bucket_ts"),
        *[F.when(F.col("_at") == F.col("bucket"), F.col(v)).otherwise(0).alias(v) for v in values],
    )


def _centred_mean(value: str, width: int, by: list[str], order: str) -> Column:
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.avg(value).over(frame)


def smooth(series: DataFrame, smooth_s: int, step_s: int) -> DataFrame:
    """Centred rolling mean of every value column over smooth_s / step_s buckets."""
    if smooth_s <= 0:
        return series
    width = max(1, int(smooth_s / step_s))
    values = [c for c in series.columns if c not in (*COMBAT, "bucket_ts")]
    return series.select(
        *COMBAT,
        "bucket_ts",
        *[_centred_mean(v, width, COMBAT, "bucket_ts").alias(v) for v in values],
    )


def series_long(series: DataFrame) -> DataFrame:
    """One row per bucket and metric, positive values only."""
    long = series.select(*COMBAT, "bucket_ts", "dps", "hps").unpivot(
        [*COMBAT, "bucket_ts"], ["dps", "hps"], "metric", "value"
    )
    return long.filter(F.col("value") > 0)


def encounter_trend(encounters: DataFrame) -> DataFrame:
    """DPS and HPS of each encounter with centred rolling means.

    The window is a third of the log's encounters, at least 2, at most 5. Each
    encounter is handed to the places it counts for, so that no task has to
    hold a whole log in order.
    """
    widths = encounters.groupBy("log_id").agg(
        F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.count(F.lit(1)) / 3))).cast("int").alias("_w")
    )
    placed = running(
        encounters.select(*COMBAT, "dps", "hps"),
        ["log_id"],
        seq_block("combat_id"),
        ["combat_id"],
        {"place": ("sum", F.lit(1))},
    )
    first = F.col("place") - F.floor((F.col("_w") - 1) / 2)
    last = F.col("place") + F.floor(F.col("_w") / 2)
    handed = placed.join(widths, "log_id").select(
        "log_id", F.col("place").alias("_own"), *COMBAT[1:], "dps", "hps",
        F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("place"),
    )
    own = F.col("_own") == F.col("place")
    rolled = handed.groupBy("log_id", "place").agg(
        F.max(F.when(own, F.col("combat_id"))).alias("combat_id"),
        F.max(F.when(own, F.col("dps"))).alias("dps"),
        F.max(F.when(own, F.col("hps"))).alias("hps"),
        F.avg("dps").alias("dps_roll"),
        F.avg("hps").alias("hps_roll"),
    )
    # Places before the first and after the last encounter have none of their own.
    return rolled.filter(F.col("combat_id").isNotNull()).select(
        *COMBAT, "dps", "hps", "dps_roll", "hps_roll"
    )


def trend_long(trend: DataFrame) -> DataFrame:
    return trend.unpivot(COMBAT, ["dps", "hps", "dps_roll", "hps_roll"], "metric", "value")


def cumulative_spans(
    events: DataFrame, step_s: int = 1, max_bars: int | None = None, max_frames: int | None = None
) -> DataFrame:
    """Damage so far of every source of every combat, as stretches of frames (from, to) with one value.

    The last frame holds all damage. For a display, max_bars keeps the best
    sources by the damage of the whole combat, and max_frames the first frames.
    Rows grow with the events, not with the length of a combat.
    """
    starts = combat_starts(events)
    timed = events.filter(is_damage() & F.col("ts").isNotNull() & F.col("source").isNotNull())
    # An event shows from the first whole step that is not before it.
    per_second = (
        timed.join(starts, COMBAT)
        .withColumn("frame", F.ceil(elapsed_us() / F.lit(step_s * 1_000_000)).cast("bigint"))
        .groupBy(*COMBAT, "source", "frame")
        .agg(F.sum("effective_amount").alias("d"), F.first("span_us").alias("span_us"))
    )
    if max_bars is not None:
        sources = per_second.groupBy(*COMBAT, "source").agg(F.sum("d").alias("total"))
        top = first_rows(sources, COMBAT, [F.desc("total"), F.col("source")], max_bars)
        per_second = per_second.join(top.select(*COMBAT, "source"), [*COMBAT, "source"], "left_semi")
    last = F.greatest(F.lit(1), F.ceil(F.col("span_us") / F.lit(step_s * 1_000_000))).cast("bigint")
    if max_frames is not None:
        last = F.least(F.lit(max_frames - 1).cast("bigint"), last)
    # Each row stands until the next one; before the first all is 0.
    order = Window.partitionBy(*COMBAT, "source").orderBy("frame")
    end = F.coalesce(F.lead("frame").over(order) - 1, last)
    stretch = lambda begin, end, damage: F.struct(
        begin.cast("bigint").alias("from_frame"), F.least(end, last).alias("to_frame"), damage.alias("damage")
    )
    none_before = F.when(F.lag("frame").over(order).isNull(), stretch(F.lit(0), F.col("frame") - 1, F.lit(0).cast("bigint")))
    held = per_second.select(
        *COMBAT,
        "source",
        F.array(none_before, stretch(F.col("frame"), end, F.coalesce(F.sum("d").over(order), F.lit(0)))).alias("_both"),
    )
    return held.select(*COMBAT, "source", F.explode("_both").alias("_one")).select(*COMBAT, "source", "_one.*").filter(
        "from_frame <= to_frame"
    )


def cumulative_frames(
    events: DataFrame, step_s: int = 1, max_bars: int | None = None, max_frames: int | None = None
) -> DataFrame:
    """cumulative_spans with one row for every step."""
    spans = cumulative_spans(events, step_s, max_bars, max_frames)
    frames = F.explode(F.sequence("from_frame", "to_frame")).alias("frame")
    return spans.select(*COMBAT, "source", "damage", frames).select(*COMBAT, "source", "frame", "damage")
