"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become token ids; those longer than a sequence are cut into pieces, and every piece is an item. In a round,
items are dealt to tasks of bounded size and every task packs its own by best fit, largest first. Bins that are nearly
full are done, and so are those into which not even the least filled bin fits. The others are items of the next round, in
which fewer tasks see more of what is left. Rounds end with the one that a single task has packed, or as soon as a round
no longer lowers the number of bins that could still be merged.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import whole_text
from gridlore.llm.token_counts import tokenizer_path
from gridlore.llm.word_bpe import Known
from gridlore.session import materialise

SEQUENCE = 2048
END_ID = 0
TASK_ITEMS = 40_000  # items that one task packs
NEARLY_FULL = 0.999  # share of a sequence from which a bin is done


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row.

    The ids are those that the tokenizers library gives; tests hold them against it. Here they come from the merges of
    ``word_bpe``, which are several times as fast, because a corpus has many different words.
    """
    path = path or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(path)
        width = 4 * sequence
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(known.ids(t.as_py() for t in b.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole_text(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Places of the items of each bin. Every item, largest first, goes to the open bin that it fills best."""
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]  # by what is left in them
    lefts = 0  # bit r is set if a bin with r left is open
    bins: list[list[int]] = []
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        fitting = lefts >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            which = open_bins[left].pop()
            if not open_bins[left]:
                lefts &= ~(1 << left)
            bins[which].append(at)
        else:
            left, which = room, len(bins)
            bins.append([at])
        left -= size
        if left:
            open_bins[left].append(which)
            lefts |= 1 << left
    return bins


def _packed(items: DataFrame, room: int, turn: int) -> DataFrame:
    """child, parent, offset, fill: where every item of each partition lies in its bin, and the fill of that bin.

    Parents are numbers that no other bin has. A task holds a number and a size for each of its items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            ids.append(b.column("bin").to_numpy())
            sizes.append(b.column("fill").to_numpy().astype(np.int64))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        base = (turn << 58) | (TaskContext.get().partitionId() << 32)
        bins = best_fit(sizes.tolist(), room)
        members = np.fromiter(itertools.chain.from_iterable(bins), np.int64, len(sizes))
        counts = np.fromiter(map(len, bins), np.int64, len(bins))
        own = sizes[members]
        starts = np.cumsum(counts) - counts
        before = np.cumsum(own) - own
        fills = np.add.reduceat(own, starts) if len(bins) else own
        offset = before - np.repeat(before[starts], counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[members]), pa.array(np.repeat(base + np.arange(len(bins)), counts)), pa.array(offset), pa.array(np.repeat(fills, counts))],
            ["child", "parent", "offset", "fill"],
        )

    return items.mapInArrow(run, "child long, parent long, offset long, fill long")


def pack(
    docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, task_items: int = TASK_ITEMS,
    nearly_full: float = NEARLY_FULL,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``.

    A null or empty text is the end id alone. Repeated rows are packed each for itself, and a null id is kept as it is. Long
    texts are read in blocks. Other columns are not read; an empty table gives an empty result.

    Rounds only move the number and fill of bins. Where items lie within bins, and these within bins of the next round, is
    kept in one table of links per round; they are followed at the end, from the last round to the first.
    """
    cut = pieces(docs, path, sequence, end_id)
    numbered = materialise(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = numbered.filter(F.col("length") < sequence)
    items, n, rounds = short.select(F.col("item").alias("bin"), F.col("length").alias("fill")), short.count(), []
    while n:
        tasks = max(1, -(-n // task_items))
        # a fixed order within tasks that are dealt by number: a task that runs again makes the same bins
        dealt = items.repartition(tasks, F.xxhash64("bin", F.lit(len(rounds)))).sortWithinPartitions("bin")
        links = materialise(_packed(dealt, sequence, len(rounds)), "links")
        rounds.append(links)
        if tasks == 1:
            break
        underfull = links.filter((F.col("offset") == 0) & (F.col("fill") < nearly_full * sequence)).select(F.col("parent").alias("bin"), "fill")
        least = underfull.agg(F.min("fill")).first()[0]
        # a bin that even the least filled one does not fit into is done as well
        items = underfull.filter(F.col("fill") + F.lit(least) <= sequence) if least is not None else underfull
        left = items.count()
        if left < 2 or left >= n:
            break
        n = left
    placed = numbered.filter(F.col("length") == sequence).select(
        F.col("item").alias("child"), (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    above = None
    for turn, links in enumerate(reversed(rounds)):
        own = links.select("child", F.col("parent").alias("sequence_id"), "offset")
        if above is not None:
            up = above.toDF("_bin", "_sequence", "_offset")
            own = links.join(up, F.col("parent") == F.col("_bin"), "left").select(
                "child", F.coalesce("_sequence", "parent").alias("sequence_id"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset")
            )
        above = materialise(own, "placed") if turn + 1 < len(rounds) else own
    if above is not None:
        placed = placed.unionAll(above)
    return numbered.join(placed, F.col("item") == F.col("child")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
