"""Ordered scans that stay parallel inside one large key.

A plain ``Window.partitionBy(log_id)`` puts a whole log in one task. Here each
key is cut into blocks that follow its order. Windows run inside a block; one
summary row per block carries the state over from the blocks before it. Only
the summary rows of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one block at most, for keys ordered by a row number.
BLOCK_BITS = 20


def seq_block(seq: str = "seq") -> Column:
    """Block of a row number: non-decreasing in it, at most 2**20 rows each."""
    return F.shiftright(F.col(seq), BLOCK_BITS)


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def running(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[str],
    outputs: dict[str, tuple[str, Column]],
    before: bool = False,
) -> DataFrame:
    """Running values over ``order`` within ``keys``.

    outputs: name to ("sum" | "max" | "last", column); "max" and "last" skip nulls.
    With ``before`` the row itself is left out. ``block`` must not decrease along
    ``order``.
    """
    rows = df.withColumn("_block", block)
    for name, (_, value) in outputs.items():
        rows = rows.withColumn(f"_in_{name}", value)
    here = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local, totals, carried, merged = {}, [], [], {}
    for name, (kind, _) in outputs.items():
        value = F.col(f"_in_{name}")
        if kind == "sum":
            local[f"_at_{name}"] = F.sum(value).over(here)
            totals.append(F.sum(value).alias(f"_all_{name}"))
            carried.append(F.sum(f"_all_{name}").over(earlier).alias(f"_carry_{name}"))
            merged[name] = F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) + F.coalesce(
                F.col(f"_at_{name}"), F.lit(0)
            )
        elif kind == "max":
            local[f"_at_{name}"] = F.max(value).over(here)
            totals.append(F.max(value).alias(f"_all_{name}"))
            carried.append(F.max(f"_all_{name}").over(earlier).alias(f"_carry_{name}"))
            merged[name] = F.greatest(F.col(f"_carry_{name}"), F.col(f"_at_{name}"))
        elif kind == "last":
            local[f"_at_{name}"] = F.last(value, ignorenulls=True).over(here)
            totals.append(
                F.max_by(value, F.when(value.isNotNull(), _order_struct(order))).alias(f"_all_{name}")
            )
            carried.append(
                F.last(f"_all_{name}", ignorenulls=True).over(earlier).alias(f"_carry_{name}")
            )
            merged[name] = F.coalesce(F.col(f"_at_{name}"), F.col(f"_carry_{name}"))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    carry = (
        rows.groupBy(*keys, "_block").agg(*totals).select(*keys, "_block", *carried)
    )
    return (
        rows.withColumns(local)
        .join(carry, [*keys, "_block"])
        .select(*[c for c in df.columns if c not in merged], *[v.alias(k) for k, v in merged.items()])
    )


def sessions(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[str],
    state: list[str],
    is_new: Callable[[Column, Column], Column],
    name: str,
) -> DataFrame:
    """Number the sessions of each key 1, 2, ...

    A row opens a session if ``is_new(previous, current)`` holds for the
    structs of its ``state`` columns, or if it is the first row of the key.
    """
    rows = df.withColumn("_block", block).withColumn("_now", F.struct(*state))
    here = Window.partitionBy(*keys, "_block").orderBy(*order)
    previous = F.lag("_now").over(here)
    rows = rows.withColumn("_prev", previous)
    rows = rows.withColumn(
        "_new", F.when(F.col("_prev").isNotNull() & is_new(F.col("_prev"), F.col("_now")), 1).otherwise(0)
    )
    rows = rows.withColumn(
        "_opened", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    blocks = (
        rows.groupBy(*keys, "_block")
        .agg(
            F.min_by("_now", _order_struct(order)).alias("_head"),
            F.max_by("_now", _order_struct(order)).alias("_tail"),
            F.sum("_new").alias("_inner"),
        )
        .withColumn("_before", F.lag("_tail").over(along))
        .withColumn(
            "_edge",
            F.when(F.col("_before").isNull() | is_new(F.col("_before"), F.col("_head")), 1).otherwise(0),
        )
        .withColumn(
            "_base",
            F.sum("_edge").over(along.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(
                F.sum("_inner").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select(*keys, "_block", "_base")
    )
    return rows.join(blocks, [*keys, "_block"]).select(
        *df.columns, (F.col("_base") + F.col("_opened")).cast("bigint").alias(name)
    )
