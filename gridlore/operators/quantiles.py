"""Exact quantiles of many columns at once, by two scans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.operators.sequences import in_ranges
from gridlore.session import materialise

ACCURACY = 1_000  # of the sketch: it is wrong by at most this part of all ranks
MARGIN = 3  # times that error, by which a range of values reaches beyond a wanted rank on both sides


def number(column: str) -> Column:
    """A cell as a double; not-a-number counts as missing."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with one row per cell that is not null."""
    cast = df.select(*[number(c).alias(c) for c in columns])
    return cast.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value").where(
        "value IS NOT NULL"
    )


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, value) with linear interpolation between neighbours, exact at any size.

    The first scan takes a mergeable sketch of every column, side by side, whose bound on ranks gives a range of values around
    every wanted rank. The second counts the cells below each range, and how often each value inside it occurs; only what lies
    in a range, a few thousandths of all cells, is shuffled. Values are then counted up in contiguous ranges of their order,
    so that no task holds or sorts a column. What reaches the driver is two numbers per column and probability.
    """
    n, spans = _ranges(df, columns, probs)
    wanted = [
        (i, c, p, p * (n[c] - 1), rank)
        for i, (c, p) in enumerate(spans)
        for rank in sorted({math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1))})
    ]
    session = df.sparkSession
    kind = "span int, column string, prob double, position double, rank long"
    ranks = session.createDataFrame(wanted, kind)
    found = _selected(df, spans, ranks)
    # the bound holds for sketches merged in any order; should a rank lie outside its range all the same, its column is counted whole
    lost = ranks.join(found.select("span", "rank"), ["span", "rank"], "left_anti").select("span").distinct().collect() if wanted else []
    if lost:
        whole = {r.span for r in lost}
        spans = {k: (-math.inf, math.inf) if i in whole else v for i, (k, v) in enumerate(spans.items())}
        found = _selected(df, spans, ranks)
    share = F.col("position") - F.floor("position")
    weight = F.when(F.col("rank") == F.floor("position"), 1 - share).otherwise(share)
    return found.groupBy("column", "prob").agg(F.sum(weight * F.col("value")).alias("value"))


def _ranges(df: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict[str, int], dict[tuple[str, float], tuple[float, float]]]:
    """The number of cells of each column, and for each column with cells and probability the range of values to count."""
    reach = MARGIN / ACCURACY
    points = [min(max(p + side * reach, 0.0), 1.0) for p in probs for side in (-1, 1)]
    row = df.agg(
        *(F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)),
        *(F.percentile_approx(number(c), points, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)),
    ).first()
    n = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    spans = {}
    for i, c in enumerate(columns):
        for k, p in enumerate(probs if n[c] else []):
            low, high = row[f"q{i}"][2 * k : 2 * k + 2]
            # beyond the sketch's first and last ranks there is nothing to leave out
            spans[c, p] = (-math.inf if p <= reach else low, math.inf if p >= 1 - reach else high)
    return n, spans


def _selected(df: DataFrame, spans: dict[tuple[str, float], tuple[float, float]], ranks: DataFrame) -> DataFrame:
    """The wanted ranks with their values."""
    columns = list(dict.fromkeys(c for c, _ in spans))
    of = [columns.index(c) for c, _ in spans]
    bounds = list(spans.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for column in b.columns:
                x = column.drop_null().to_numpy(zero_copy_only=False) + 0.0  # minus zero is zero
                cells.append(x)
            span, value, count = [], [], []
            for i, (low, high) in enumerate(bounds):
                x = cells[of[i]]
                below = int((x < low).sum())
                inside, times = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                span.append(np.full(len(inside) + 1, i))
                value += [pa.array([None], pa.float64()), pa.array(inside, pa.float64())]
                count.append(np.r_[below, times])
            if span:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(span), pa.int32()), pa.concat_arrays(value), pa.array(np.concatenate(count), pa.int64())],
                    ["span", "value", "n"],
                )

    numbers = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(columns)]) if columns else df.select(F.lit(0.0).alias("x"))
    counted = numbers.mapInArrow(run, "span int, value double, n long").groupBy("span", "value").agg(F.sum("n").alias("n"))
    # a null value, the number of cells below a range, sorts before the values inside it
    rows = in_ranges(counted, ["span", "value"])
    totals = rows.groupBy("_part", "span").agg(F.sum("n").alias("_total"))
    before = Window.partitionBy("span").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of the order
    totals = totals.select("_part", "span", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    upto = Window.partitionBy("_part", "span").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_inside", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(totals, ["_part", "span"])
    below = F.col("_inside") + F.col("_offset")
    placed = running.where("value IS NOT NULL").select(F.col("span").alias("_span"), "value", below.alias("_before"), (below + F.col("n")).alias("_upto"))
    hit = (F.col("_span") == F.col("span")) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto"))
    return materialise(placed.join(F.broadcast(ranks), hit).select(*ranks.columns, "value"), "ranks")


def wide(quantile_rows: DataFrame, names: dict[float, str]) -> DataFrame:
    """One row per column with a named column per probability."""
    picks = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]
    return quantile_rows.groupBy("column").agg(*picks)
