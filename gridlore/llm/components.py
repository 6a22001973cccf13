"""Connected components of a graph given by its links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root: one row for every node that a link names; nodes with the same root are connected.

    In each round every node steps to the first of itself and its neighbours, in a fixed random order, and links are
    redrawn between the nodes that are left. Only nodes that come before all their neighbours are left, so that stars and
    cliques of any size take two rounds. Nothing is collected; a round's tables are written and read again.
    """

    def order(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    left = materialise(links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionAll(left.select("b", "a"))
        step = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = materialise(step.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("root")), "steps")
        steps.append(step)
        ends = left.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").filter("ra <> rb")
        left = materialise(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0]
    for step in steps[1:]:
        roots = roots.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
