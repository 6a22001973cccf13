"""Audit of how filters interact, on statistics from a table-driven pass over bytes.

A finite-state machine reads the UTF-8 bytes of many texts at once. Its state after a byte depends on that byte alone (in
a word or not), so the steps of a whole buffer are looked up together in one table, which gives for every state and byte
what begins or is counted there: words, capitals, code points, symbols. Word spans go into an open hash table, where a
span is compared byte by byte with the one that holds its slot, so that different words are never taken for one.

A document fails a set of filters. Documents are counted by that set within each part of the table, and the counts, at most
32 for each part, are enough to follow all orders in which the filters may be applied.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.session import materialise

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
SLICE_BYTES = 1 << 20  # of texts that go through the machine at a time; longer texts alone, in blocks of this size
LANE_WORDS = 8  # words of up to so many lanes of 8 bytes are hashed by lanes, longer ones as byte strings
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# what a step gives out
WORD_START, WORD_END, CAPITAL, CODE_POINT, SYMBOL = 1, 2, 4, 8, 16


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte (0 between words, 1 in a word), and what each (state, byte) gives out."""
    byte = np.arange(256)
    state = np.ones(256, np.uint8)
    state[[0x20, *range(0x09, 0x0E)]] = 0
    out = np.zeros((2, 256), np.uint8)
    out[0, state == 1] |= WORD_START
    out[1, state == 0] |= WORD_END
    out[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    out[:, byte & 0xC0 != 0x80] |= CODE_POINT
    out[:, list(SYMBOLS)] |= SYMBOL
    return state, out


STATE, OUT = transducer()


def _lanes(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lane: int) -> np.ndarray:
    """Eight bytes of each span from byte 8 * lane on, with zeros beyond its end."""
    left = np.clip(lengths - 8 * lane, 0, 8).astype(np.uint64)
    mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1))
    return windows[np.minimum(starts + 8 * lane, len(windows) - 1)] & mask


def first_spans(buffer: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each span whether it is the one of its text that holds the word in the hash table.

    ``buffer`` ends with at least 8 spare bytes. Every span that is not settled looks at its slot: of those at an empty slot
    one gets in; a span that equals the holder, in text, length and all bytes, is settled; the others go on to the next slot.
    """
    n = len(starts)
    windows = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
    lanes = int(lengths.max(initial=0) + 7) // 8
    with np.errstate(over="ignore"):
        mixed = (text.astype(np.uint64) << np.uint64(32) | lengths.astype(np.uint64)) * MULTIPLIER
        for lane in range(lanes):
            own = np.flatnonzero(lengths > 8 * lane)
            x = (mixed[own] ^ _lanes(windows, starts[own], lengths[own], lane)) * MULTIPLIER
            mixed[own] = x ^ x >> np.uint64(29)
        bits = max(4, int(2 * n).bit_length())
        slot = (mixed * MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int64)
    first = np.zeros(n, bool)
    open_ = np.arange(n)
    while len(open_):
        at = slot[open_]
        empty = table[at] < 0
        # of several spans at an empty slot, the one that stands first gets in
        table[at[empty][::-1]] = open_[empty][::-1]
        holder = table[at]
        first[open_[holder == open_]] = True
        same = (text[holder] == text[open_]) & (lengths[holder] == lengths[open_])
        for lane in range(lanes):
            own = np.flatnonzero(same & (lengths[open_] > 8 * lane))
            if not len(own):
                break
            a, b = holder[own], open_[own]
            same[own] = _lanes(windows, starts[a], lengths[a], lane) == _lanes(windows, starts[b], lengths[b], lane)
        open_ = open_[~same]
        slot[open_] = (slot[open_] + 1) & (len(table) - 1)
    return first


def _pass(data: bytes | memoryview, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Counts (words, capitals, code points, symbols) of each text of a buffer, its word spans (text, start, length), and the padded buffer."""
    n = len(offsets) - 1
    buffer = np.zeros(len(data) + 8, np.uint8)
    buffer[: len(data)] = np.frombuffer(data, np.uint8)
    own = buffer[: len(data)]
    after = STATE[own]
    before = np.zeros(len(own), np.uint8)
    before[1:] = after[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[begins] = 0  # each text starts between words
    out = OUT.reshape(-1)[before.astype(np.int64) << 8 | own]

    def per_text(kind: int) -> np.ndarray:
        total = np.zeros(len(own) + 1, np.int64)
        np.cumsum(out & kind != 0, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts = np.flatnonzero(out & WORD_START)
    # a word ends before a blank or with its text
    ends = np.flatnonzero(out & WORD_END)
    last = offsets[1:][offsets[1:] > offsets[:-1]]
    ends = np.sort(np.concatenate([ends, last[after[last - 1] == 1]]))
    text = np.searchsorted(offsets, starts, "right") - 1
    counts = np.stack([per_text(k) for k in (WORD_START, CAPITAL, CODE_POINT, SYMBOL)]) if n else np.zeros((4, 0), np.int64)
    return counts, (text, starts, ends - starts), buffer


def measure(data: bytes | memoryview, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of the texts that lie between the offsets of a buffer: a row each."""
    counts, (text, starts, lengths), buffer = _pass(data, offsets)
    short = lengths <= 8 * LANE_WORDS
    distinct = np.zeros(len(offsets) - 1, np.int64)
    if len(starts):
        s = np.flatnonzero(short)
        first = first_spans(buffer, text[s], starts[s], lengths[s])
        distinct += np.bincount(text[s[first]], minlength=len(distinct))
        # byte strings in a set are compared in full as well
        long = {(t, buffer[a : a + n].tobytes()) for t, a, n in zip(*(x[~short].tolist() for x in (text, starts, lengths)), strict=True)}
        for t, _ in long:
            distinct[t] += 1
    return np.stack([counts[0], distinct, *counts[1:]])


def measure_long(data: bytes, block: int = SLICE_BYTES) -> np.ndarray:
    """The same for one long text, block by block; blocks end before a blank. What is held are its different words."""
    known: set[bytes] = set()
    total = np.zeros(4, np.int64)
    at = 0
    while at < len(data):
        end = at + block
        while end < len(data) and STATE[data[end]]:
            end += 1
        end = min(end, len(data))
        counts, (text, starts, lengths), buffer = _pass(memoryview(data)[at:end], np.array([0, end - at]))
        total += counts[:, 0]
        s = np.flatnonzero(lengths <= 8 * LANE_WORDS)
        new = np.concatenate([s[first_spans(buffer, text[s], starts[s], lengths[s])], np.flatnonzero(lengths > 8 * LANE_WORDS)])
        known.update(buffer[a : a + n].tobytes() for a, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True))
        at = end
    return np.array([[total[0]], [len(known)], [total[1]], [total[2]], [total[3]]])


def _slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together; a longer text is a run of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def statistics(rows: DataFrame, text: str = "_text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows without the binary column ``text``, with _words, _distinct, _capitals, _code_points and _symbols."""
    names = ["_words", "_distinct", "_capitals", "_code_points", "_symbols"]
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text).cast(pa.large_binary())
            # the bytes of all texts lie in one buffer, one after the other
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            whole = memoryview(column.buffers()[2] or b"")
            parts = [np.zeros((5, 0), np.int64)]
            for lo, hi in _slices(offsets, limit):
                begin, end = int(offsets[lo]), int(offsets[hi])
                data = whole[begin:end]
                parts.append(measure_long(bytes(data), limit) if end - begin > limit else measure(data, offsets[lo : hi + 1] - begin))
            found = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, found)], [*keep, *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, kinds + "".join(f", {n} long" for n in names))


def own_failures() -> dict[str, Column]:
    """Filters A to D on the statistics: few words, few different words, many capitals, symbols."""
    words, code_points = F.col("_words"), F.col("_code_points")
    return {
        "A": words < 200,
        "B": 100 * F.col("_distinct") < 50 * words,
        "C": 100 * F.col("_capitals") > 2 * code_points,
        "D": F.col("_symbols") > 0,
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: how many documents of each part fail which filters, as a string of their letters.

    The part is the source, null as an empty string. A null text counts as empty. Filter E compares 256-bit digests of whole
    texts with the smallest id of each; a document without id comes after all ids, and equal texts without any id, or under
    one repeated id, do not precede each other. Of several labels of an id the larger counts; documents without id have none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("_sha"),
        text.cast("binary").alias("_text"),
    )
    own = F.concat_ws("", *(F.when(c, F.lit(letter)) for letter, c in own_failures().items()))
    measured = materialise(statistics(rows).select("_id", "part", F.unhex("_sha").alias("_sha"), own.alias("_own")), "measured")
    # the aggregate is written before it is joined, so that a hot text can be split
    first = measured.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_times")).filter("_times > 1")
    first = materialise(first.drop("_times"), "first-of-text").withColumnRenamed("_sha", "_same")
    copies = measured.join(first, F.col("_sha") == F.col("_same"), "left")
    later = F.coalesce((F.col("_id") > F.col("_first")) | (F.col("_id").isNull() & F.col("_first").isNotNull()), F.lit(False))
    marked = copies.select("_id", "part", F.concat("_own", F.when(later, F.lit("E")).otherwise(F.lit(""))).alias("fails"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic")
    )
    known = materialise(known, "labels")
    joined = marked.join(known, F.col("_id") == F.col("_labelled"), "left")
    return joined.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_toxic") == 1).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for every part of the table, order of the filters and step, zeros included. Repeated rows count each for itself;
    an empty table has no parts and gives no rows. Whole texts of any length are read; other columns are not.
    """
    counts = materialise(judged(docs, labels), "failures")
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    each = counts.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    gone = F.exists(F.lit(list(FILTERS)), lambda f: F.contains(F.col("fails"), f) & F.contains(before, f))
    each = each.withColumn("letter", letter).withColumn("_gone", gone)
    fails = F.contains(F.col("fails"), F.col("letter"))
    here = fails & ~F.col("_gone")

    def total(holds: Column, value: str = "n") -> Column:
        return F.sum(F.when(holds, F.col(value)).otherwise(0))

    steps = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("_gone") & ~fails).alias("kept"), total(here).alias("removed"), total(fails & F.col("_gone")).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    steps = materialise(steps, "steps")
    shares = steps.groupBy(F.col("part").alias("_part"), F.col("letter").alias("_letter")).agg(F.sum("removed").alias("shapley"))
    joined = steps.join(shares, (F.col("part") == F.col("_part")) & (F.col("letter") == F.col("_letter")))
    return joined.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
