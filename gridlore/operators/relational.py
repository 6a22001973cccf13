"""Filters, joins and grouped reports in the shapes people ask tables about."""

from __future__ import annotations

import functools
import operator
import re
from datetime import date
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators.grouped import with_group
from gridlore.operators.sequences import with_rank


# ---- filters -------------------------------------------------------------------------------------


def like_any_case(column: str, pattern: str) -> Column:
    """LIKE without regard to case."""
    return F.col(column).ilike(pattern)


def above_average(df: DataFrame, column: str) -> DataFrame:
    """Rows above the mean of a column; the mean is a scalar subquery, not a join."""
    return df.where(F.col(column) > df.select(F.avg(column)).scalar())


def in_date_parts(
    df: DataFrame, column: str, year: int | None = None, quarter: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Rows in a year, quarter or month. A year becomes a range, which Parquet can skip by."""
    if year is not None:
        df = df.where(
            (F.col(column) >= F.lit(date(year, 1, 1))) & (F.col(column) < F.lit(date(year + 1, 1, 1)))
        )
    if quarter is not None:
        df = df.where(F.quarter(column) == quarter)
    if month is not None:
        df = df.where(F.month(column) == month)
    return df


def within_last(df: DataFrame, column: str, interval: str) -> DataFrame:
    """Rows no older than an interval before the latest row, so that a rerun gives the same rows."""
    latest = df.select(F.max(column)).scalar()
    return df.where(F.col(column) >= latest - F.expr(f"INTERVAL {interval}"))


def within_elapsed(column: str, other: str, interval: str) -> Column:
    """Two times of one row lie no further apart than an interval."""
    span = F.expr(f"INTERVAL {interval}")
    return F.col(column).between(F.col(other) - span, F.col(other) + span)


COMPARISONS = {
    "=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt,
    "<=": operator.le,
}


QUOTED_NUMBER = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?\s*"
WIDEST = 38  # digits that a decimal literal can have


def compare_quoted(df: DataFrame, column: str, comparison: str, literal: str) -> Column:
    """Compare a number column with quoted text as numbers: ``x > '-12.5'`` means ``x > -12.5``.

    The text is read while planning and becomes a literal of the column's type, so that the comparison reaches the
    scan. Text that is no number is unequal to every number and otherwise matches nothing.
    """
    cell, kind = F.col(column), df.schema[column].dataType
    unequal, always, never = comparison == "!=", F.col(column).isNotNull(), F.lit(False)
    if not re.fullmatch(QUOTED_NUMBER, literal):
        return always if unequal else never
    value = Decimal(literal.strip())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return COMPARISONS[comparison](cell, F.lit(float(value)).cast(kind))
    if isinstance(kind, T.IntegralType):
        if value.adjusted() >= 18:  # beyond every whole number of the column
            holds = unequal or (comparison in ("<", "<=")) == (value > 0) and comparison != "="
            return always if holds else never
        below = int(value.to_integral_value(ROUND_FLOOR))
        if below != value:  # between two whole numbers
            if comparison in ("=", "!="):
                return always if unequal else never
            comparison = ">" if comparison in (">", ">=") else "<="
        return COMPARISONS[comparison](cell, F.lit(below).cast(kind if abs(below) < 2**31 else T.LongType()))
    exact = isinstance(kind, T.DecimalType) and value.normalize().as_tuple().exponent >= -kind.scale
    if exact and value.adjusted() < kind.precision - kind.scale:
        return COMPARISONS[comparison](cell, F.lit(f"{value:f}").cast(kind))
    if len(value.as_tuple().digits) > WIDEST or abs(value.adjusted()) >= WIDEST:
        return COMPARISONS[comparison](cell.cast("double"), F.lit(float(value)))
    return COMPARISONS[comparison](cell, F.lit(value))


def in_quoted(df: DataFrame, column: str, literals: list[str]) -> Column:
    """``x IN ('1', '20.5')`` on a number column; texts that are no numbers match nothing."""
    return functools.reduce(operator.or_, [compare_quoted(df, column, "=", t) for t in literals], F.lit(False))


# ---- records that share a value ------------------------------------------------------------------


def sharing_value(df: DataFrame, value: str, key: str) -> DataFrame:
    """Rows whose value also occurs under another key, with the number of those partners and one of them.

    One row per record: the partners of a record are all other records with its value, so listing every
    pair would repeat each group as often as it has members. The named partner is the smallest key of
    the group, or the largest for the smallest itself. A value of any share of all rows spreads over tasks.
    """
    low, high = F.min(key).alias("_low"), F.max(key).alias("_high")
    rows = with_group(df, [value], F.count("*").alias("_n"), low, high, where="_n > 1")
    is_low = F.col(key) == F.col("_low")
    return rows.select(
        *df.columns,
        (F.col("_n") - 1).alias("partners"),
        F.when(is_low, F.col("_high")).otherwise(F.col("_low")).alias("partner"),
    )


def pair_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """Number of unordered pairs of records within each group, without building them."""
    return (
        df.groupBy(*group)
        .agg(F.count("*").alias("records"))
        .where("records > 1")
        .select(*group, "records", F.expr("records * (records - 1) div 2").alias("pairs"))
    )


def duplicated_groups(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")


# ---- grouped reports -----------------------------------------------------------------------------


def money(column: str) -> Column:
    """An amount in exact decimals, so that a sum does not depend on the order of its terms."""
    return F.col(column).cast("decimal(18,2)")


def total_by_dimension(
    facts: DataFrame, fact_key: str, measure: Column, dimension: DataFrame, dim_key: str, by: str,
    name: str,
) -> DataFrame:
    """Sum a measure by an attribute of a joined table.

    The sum is taken per key before the join: the partial sums shrink a hot key to one row per task, so
    the join moves at most one row per key and task however skewed the facts are.
    """
    per_key = facts.groupBy(fact_key).agg(F.sum(measure).alias("_part"))
    return (
        per_key.join(dimension.select(dim_key, by), F.col(fact_key) == F.col(dim_key))
        .groupBy(by)
        .agg(F.sum("_part").alias(name))
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts every task's rows to n per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rate_by(df: DataFrame, by: str, flag: Column, name: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(flag.cast("double")).alias(name)
    )


def binned(column: str, width: float) -> Column:
    return F.floor(F.col(column) / width) * F.lit(width)


def most_common(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most common value per group; ties go to the smallest value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    top = top_per_group(counts, group, [F.col("n").desc(), F.col(value).asc()])
    return top.select(group, value, "n")


def monthly(df: DataFrame, column: str, *aggs: Column) -> DataFrame:
    return df.groupBy(F.trunc(column, "month").alias("month")).agg(*aggs)


def change_from_previous(df: DataFrame, period: str, measure: str) -> DataFrame:
    """Difference to the previous period. ``df`` holds one row per period, not raw rows."""
    w = Window.orderBy(period)
    return df.withColumn("previous", F.lag(measure).over(w)).withColumn(
        "change", F.col(measure) - F.col("previous")
    )


def leading_group(groups: DataFrame, name: str, value: str) -> DataFrame:
    """Number of groups and the group with the largest value (ties: smallest name), as one row."""
    first = groups.orderBy(F.col(value).desc(), F.col(name).asc()).limit(1)
    counted = groups.select(F.count("*")).scalar()
    return first.select(counted.alias("groups"), F.col(name).alias("leader"), F.col(value).alias("leader_value"))


def group_summary(groups: DataFrame, name: str, value: str) -> DataFrame:
    """All groups of a result by value, largest first (ties: smallest name), with their place, whether they lead, and the
    number of groups. Groups without a value come last and never lead. The order is made in ranges, so that any number of groups will do.
    """
    ranked = with_rank(groups, [F.col(value).desc_nulls_last(), F.col(name).asc()], "place")
    counted = groups.select(F.count("*")).scalar()
    leads = (F.col("place") == 1) & F.col(value).isNotNull()
    return ranked.select(name, value, F.col("place").cast("bigint").alias("place"), leads.alias("leads"), counted.alias("groups"))
