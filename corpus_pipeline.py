"""From documents to packed training sequences: quality rules, exact dedup, near dedup, source mix, packing.

Each stage takes what the one before has written and reads it anew, so that a stage that is repeated after a loss does not
repeat those before it. All stages but the last return the columns of their input. In every stage a null text counts as empty,
texts are read whole whatever their length, other columns are carried along under any name, and an empty table gives an
empty one; what else is particular to a stage stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import exact_dedup, mixing, packing, quality, simhash
from gridlore.llm.common import discard, table
from gridlore.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, learnt from labelled rows that are not held out, do not reject.

    Every row is scored for itself: repeated rows fare alike, ids are only used to find labels. Without labels of both kinds all
    rows have one score, the share of label 1, and all stay or go together; ties at the threshold stay.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id.

    Rows without id come last, and one of them stays where a group has no id; of rows that repeat id and text, one stays. Empty
    texts are equal to each other.
    """
    return exact_dedup.without_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the document with the smallest id.

    Rows without id come last; of rows that repeat an id with other texts, the one with the smaller hash of its text stays. Texts
    without words have one fingerprint and are linked to each other.
    """
    return simhash.without_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for.

    A null source is a source of its own, last in order; documents of equal size are taken in order of id, null last; a text without
    words has size 0 and is taken as often as its place asks for, but a source without any words is not taken.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a row per piece, repeated rows each for themselves."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_similar),
    ("mix", source_mix),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)  # the table of the stage before, which nothing reads any more
    return STAGES[-1][1](spark, docs, sf_dir)


# the fitted rules, components and packing cannot be stated in SQL; tests/llm holds the stages against plain Python
ORACLE_SQL = None
