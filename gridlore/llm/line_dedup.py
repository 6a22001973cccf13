"""Line deduplication by overlapping windows of three lines. Only DataFrame functions are used.

Every three consecutive lines of a text form a window. A window that also starts earlier, in a document with a smaller
id or further up in the same document, is a later occurrence, and every line that a later occurrence covers is removed.
Windows are judged on the input, not on what is left. Texts of fewer than three lines have no window and stay.

Documents are told apart by id and text, as ids can be missing or repeated: of documents with one id, that with the smaller
hash of its text comes first, and documents without id come last. Only rows that repeat both id and text are told apart by
nothing: their windows, copies of one another at the same places, count as one document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import packed, unpacked
from gridlore.session import materialise

LINES = 3


def _hash_pair(values: Column) -> Column:
    """128 bits in two columns' worth: two hashes that start from different values."""
    return F.struct(F.xxhash64(values).alias("a"), F.xxhash64(F.lit("line"), values).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(text: Column) -> Column:
    """The second part of a document's key, a hash of its text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, _key, pos (from 0) and the hash pair (a, b) of every window."""
    text = F.col("text")
    hashes = docs.select("doc_id", key_of(text).alias("_key"), F.transform(lines_of(text), _hash_pair).alias("_h")).filter(F.size("_h") >= lines)
    starts = F.sequence(F.lit(0), F.size("_h") - lines)
    each = hashes.select("doc_id", "_key", F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.slice("_h", i + 1, F.lit(lines)).alias("w")
    ))).alias("_w"))
    return each.select("doc_id", "_key", "_w.pos", F.xxhash64("_w.w.a").alias("a"), F.xxhash64("_w.w.b").alias("b"))


def covered(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, _key and _later, the sorted starts of windows that also start earlier; only documents that have any.

    First occurrences are found by a partial aggregate, so that a very common window is one row per task before any
    shuffle. They are written, because Spark splits a hot window in the join back only if both sides come straight from a shuffle.
    """
    each = materialise(windows(docs, lines), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "_key", "pos")
    first = each.groupBy("a", "b").agg(F.min(place).alias("_first"), F.count("*").alias("_times")).filter("_times > 1")
    first = materialise(first, "firsts")
    later = each.join(first, ["a", "b"]).filter("NOT (doc_id <=> _first.doc_id AND _key = _first._key AND pos = _first.pos)")
    return later.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set("pos")).alias("_later"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """All rows and columns of ``docs``, packed in ``_row``, with _n_lines, _n_removed and _text, the text that is left.

    An empty table gives an empty one; texts of any length are cut into all their lines.

    A null text counts as empty and has one empty line. Rows that repeat id and text count as one document for its windows.
    Covered positions are merged in order: a window adds the lines that lie beyond the one before it.
    """

    def run(start: Column, k: Column) -> Column:
        end = F.when(k > 0, F.get(F.col("_later"), k - 1) + lines).otherwise(F.lit(0))
        gap, added = F.greatest(F.lit(0), start - end), start + lines - F.greatest(start, end)
        return F.concat(F.array_repeat(F.lit(True), gap), F.array_repeat(F.lit(False), added))

    stays = covered(docs, lines).select(
        F.col("doc_id").alias("_id"), "_key", F.flatten(F.transform("_later", run)).alias("_stays")
    )
    rows = packed(docs).withColumn("_own", key_of(F.col("_row.text"))).join(stays, F.expr("_row.doc_id <=> _id AND _own = _key"), "left")
    text = lines_of(F.col("_row.text"))
    kept = F.filter(text, lambda _, i: F.coalesce(F.get(F.col("_stays"), i), F.lit(True)))
    n_removed = F.coalesce(F.size(F.filter("_stays", lambda x: ~x)), F.lit(0))
    return rows.select(
        "_row", F.size(text).alias("_n_lines"), F.when(F.col("_stays").isNull(), 0).otherwise(n_removed).alias("_n_removed"),
        F.when(F.col("_stays").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("_text"),
    )


def without_repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The rows of ``docs`` with the text that is left; all other columns as they are."""
    done = dedup_lines(docs, lines)
    return unpacked(done.select(done["_row"].withField("text", F.col("_text")).alias("_row")))
