"""Mixing sources to target weights by systematic sampling. Only DataFrame functions are used.

Every source gets a share of all words by its weight, at most ``MOST`` times its own size; what a full source cannot take
goes to the others by weight. A document of a source is expected target / size times. Along the documents of a source,
in order of size, the expected copies are summed up from one random offset on, and a document is emitted once for every
whole number that the sum passes. Ordering by size lets the words taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import WORD, packed, unpacked
from gridlore.session import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def words(text) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, docs -> also target: one row per source, the only table that is ordered as a whole.

    Sources take the weights in turn, by code point, null last. Sources whose limit is smallest for their weight fill up
    first; after them, the rest of all words is shared by weight among those that are left.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("_w", weight.cast("long")).withColumn("_most", F.col("source_size") * most)
    filling = Window.orderBy((F.col("_most") / F.col("_w")), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0)))
    w = w.withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    w = w.withColumn("_full", F.col("_most") / F.col("_w") <= F.col("_left") / F.col("_w_left"))
    # the first source that is not full fixes the share of those that follow
    open_ = F.when(~F.col("_full"), F.struct(F.col("_left").alias("l"), F.col("_w_left").alias("n")))
    share = F.first(open_, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(share.isNull(), F.col("_most").cast("double")).otherwise(
        (F.col("_w") * share["l"]).cast("double") / share["n"]
    )
    return w.select("source", "source_size", "docs", target.alias("target"))


def offset(source, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on seed and source alone."""
    text = F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("/null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for every row of ``docs``.

    A null text has size 0, a null source is a source of its own. Repeated rows are rows of their own. Other columns are
    not read. An empty table gives an empty result; sources without words have target 0 and are not taken. Texts of any
    length are counted whole.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last()]
    sized = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # contiguous ranges of (source, size, doc_id), written once, so that a source spreads over many tasks
    ranged = materialise(sized.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    sizes = ranged.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(sizes, weights, most).select(
        F.col("source").alias("_s"), "source_size", "target",
        F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)).alias("_expected"),
    )
    heads = heads.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    heads = heads.withColumnRenamed("source", "_s").withColumnRenamed("_part", "_p")
    ranks = F.row_number().over(Window.partitionBy("source", "_part").orderBy("size", F.col("doc_id").asc_nulls_last()))
    ranked = ranged.withColumn("_rank", ranks)
    placed = ranked.join(heads, F.expr("source <=> _s AND _part = _p"))
    rank = (F.col("_before") + F.col("_rank")).cast("double")
    start = offset(F.col("source"), seed)
    passed = F.floor(rank * F.col("_expected") + start) - F.floor((rank - 1) * F.col("_expected") + start)
    return placed.withColumn("copies", passed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    copies = mix(docs, weights, most, seed)
    # rows that repeat id, source and size share their copies: the same number is dealt, one row after the other
    dealt = copies.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    dealt = dealt.filter("_copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_copies", "_rows"
    )
    rows = packed(docs).withColumn("_size", words(F.col("_row.text")))
    own = rows.join(dealt, F.expr("_row.doc_id <=> _id AND _row.source <=> _s AND _size = _z"))
    once = own.filter("_rows = 1").select("_row", "_copies")
    often = own.filter("_rows > 1")
    nth = F.row_number().over(Window.partitionBy("_id", "_s", "_z").orderBy(F.xxhash64("_row")))
    often = often.withColumn("_nth", nth).select("_row", F.expr("_copies div _rows + if(_nth <= _copies % _rows, 1, 0)").alias("_copies"))
    taken = once.unionAll(often.filter("_copies > 0"))
    return unpacked(taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
