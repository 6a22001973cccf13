"""Order-based operators that stay exact and balanced when one group holds a large share of all rows.

A plain window sorts a whole group in one task. Here the table is first cut into contiguous ranges of the
full order, so that a large group spreads over many ranges; windows run per (range, group), and a small
table with one row per range and group carries the state from range to range. The cut table is written
once, because both sides must see the same ranges, also after a lost executor.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.session import materialise


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The table with the number of its range in ``_part``; equal keys share a range."""
    return materialise(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )


def with_next(df: DataFrame, group: list[str], order: list[str], take: dict[str, str]) -> DataFrame:
    """Add columns of the following row of the same group: ``take`` maps source column to new name.

    ``order`` must be unique within a group; rows with a null group form a group of their own.
    """
    rows = in_ranges(df, [*group, *order])
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_take_{c}") for c in take])
    here = Window.partitionBy("_part", *group).orderBy(*order)
    inner = rows.withColumn("_inner", F.lead(row).over(here))

    heads = rows.groupBy("_part", *group).agg(F.min(row).alias("_head"))
    along = Window.partitionBy(*group).orderBy("_part")
    heads = heads.select("_part", *group, F.lead("_head").over(along).alias("_outer"))
    following = F.coalesce(F.col("_inner"), F.col("_outer"))
    return _null_safe(inner, heads, ["_part", *group], "left").select(
        *df.columns, *[following[f"_take_{c}"].alias(name) for c, name in take.items()]
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a null being equal to a null; the keys are those of the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows of a table from 1 along a unique order."""
    rows = in_ranges(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_part").orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(here))
        .join(offsets, "_part")
        .select(*df.columns, (F.col("_place") + F.col("_offset")).alias(name))
    )


def trailing_count(df: DataFrame, group: str, ts: str, window: str, name: str) -> DataFrame:
    """Add the number of rows of the same group with a time in [ts - window, ts]; ties count.

    Rows with a null group form a group of their own; a row without a time is counted nowhere and gets no number.

    Rows are first counted per (group, time), so a time with many rows is one row from here on. The count
    is the running total at ``ts`` less the running total just before ``ts - window``; both come from one
    running sum in which each time appears twice: with its rows, and as a probe at its window's start.
    """
    moments = df.where(F.col(ts).isNotNull()).groupBy(group, ts).agg(F.count("*").alias("_n"))
    start = F.col(ts) - F.expr(f"INTERVAL {window}")
    points = moments.select(
        group,
        ts,
        F.explode(
            F.array(
                F.struct(F.col(ts).alias("_at"), F.lit(1).alias("_sign"), F.col("_n").alias("_w")),
                F.struct(start.alias("_at"), F.lit(-1).alias("_sign"), F.lit(0).cast("bigint").alias("_w")),
            )
        ).alias("_p"),
    ).select(group, ts, "_p.*")
    rows = in_ranges(points, [group, "_at", "_sign"])

    totals = rows.groupBy("_part", group).agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    upto = (
        Window.partitionBy("_part", group)
        .orderBy("_at", "_sign")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = _null_safe(rows.withColumn("_inside", F.sum("_w").over(upto)), offsets, ["_part", group])
    counted = running.groupBy(group, ts).agg(
        F.sum(F.col("_sign") * (F.col("_inside") + F.col("_offset"))).alias(name)
    )
    return _null_safe(df, counted, [group, ts], "left").select(*df.columns, name)
