"""Rows next to the aggregates of their own group, however large a group is."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.session import materialise


def written_groups(df: DataFrame, keys: list[str | Column], *aggs: Column, where: str = "true") -> DataFrame:
    """One row per group, written.

    The groups are aggregated in part before any shuffle, so that a large group is one row per task. They are written because
    Spark splits a skewed partition of a join only if both sides come straight from a shuffle: an aggregate on the join key
    would already lie by that key, and the whole of a hot group would go to one task.
    """
    return materialise(df.groupBy(*keys).agg(*aggs).where(where), "groups")


def with_group(df: DataFrame, keys: list[str], *aggs: Column, where: str = "true", null_groups: bool = False) -> DataFrame:
    """The rows of ``df`` whose group satisfies ``where``, with the aggregates of their group.

    Rows with a null key are left out, or with ``null_groups`` form groups as other values do. ``df`` is read twice; a
    result of long computations should be written first. Names of aggregates must differ from those of columns.
    """
    groups = written_groups(df, keys, *aggs, where=where)
    mine = {k: f"_group_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(g)) if null_groups else F.col(k) == F.col(g) for k, g in mine.items()]
    joined = df.join(groups.withColumnsRenamed(mine), functools.reduce(operator.and_, same))
    return joined.drop(*mine.values())
