"""Near duplicates by SimHash and pivot distance tables.

A fingerprint has a bit for each of 64 majorities over the hashes of a text's word shingles. Fingerprints at most
``MAX_BITS`` apart are linked, and linked fingerprints form groups. The distances of every fingerprint to ``PIVOTS``
reference fingerprints are computed first: by the triangle inequality, two fingerprints whose distances to any one
reference differ by more than ``MAX_BITS`` are no pair and are discarded; those that are left are verified bit by bit.

Distances to references alone cannot deal fingerprints to tasks (those of unlike texts all lie near 32, so a reference
keeps more than half of all pairs). Fingerprints therefore meet by pigeonhole: the 64 bits are cut into ``MAX_BITS + 2``
blocks, a linked pair agrees on two of them at least, and every choice of two blocks is a key. Large groups are cut
into tiles, each a task's work of bounded size, and a tile gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import packed, unpacked, whole_text
from gridlore.llm.components import components
from gridlore.session import materialise

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
TILE = 2048  # fingerprints of one key that a task compares with as many others
SMALL = 16  # groups up to this size are compared together, larger ones one by one
READ_BYTES = 1 << 20  # of a text that are cut into words at a time


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text, which is read in blocks that end at white space."""
    import xxhash

    hash_of, out, carry, pos = xxhash.xxh64_intdigest, [], [], 0
    white = re.compile(rb"[\x20\x09-\x0D]")
    while pos < len(data):
        stop = white.search(data, pos + READ_BYTES)
        end = stop.start() if stop else len(data)
        words = carry + data[pos:end].lower().split()
        pos = end
        n = len(words) - shingle + 1
        if n > 0:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: n - 1] + 1).tolist()]
            pieces = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
            out.append(np.fromiter(map(hash_of, pieces, repeat(SEED)), np.uint64, n))
            words = words[n:]
        carry = words
    if not out and carry:
        out.append(np.array([hash_of(b" ".join(carry), SEED)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of every list of hashes: bits that are set in over half of it; zero for an empty list.

    Eight bits of each hash are counted at a time, one in each byte of a word, in runs of at most 255 hashes.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, sizes = np.concatenate([hashes[i] for i in full]), sizes[full]
    ends = np.cumsum(sizes)
    runs = np.concatenate([np.arange(e - n, e, 255) for e, n in zip(ends, sizes, strict=True)])
    first = np.searchsorted(runs, ends - sizes)
    bits = np.zeros((len(full), 64), np.uint8)
    for shift in range(8):
        lanes = (flat >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, runs).view(np.uint8).reshape(-1, 8)
        bits[:, shift::8] = np.add.reduceat(counts, first, axis=0, dtype=np.int64) * 2 > sizes[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, 64 bits as a long, for every row; a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            found = majorities([shingle_hashes(t.as_py().encode(), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole_text(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int) -> list[int]:
    """For every choice of two blocks the mask of their bits, as a signed long."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    both = [x | y for x, y in combinations(parts, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def references(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, np.uint64)


def linked(group: np.ndarray, prints: np.ndarray, max_bits: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal, adjacent group numbers, at least a spanning forest of every group's links."""
    table = np.bitwise_count(prints[None, :] ^ references()[:, None]).astype(np.int8)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the pairs that no reference discards and that are verified."""
        at = np.arange(len(y))
        for distances in table:
            at = at[np.abs(distances[x[at]] - distances[y[at]]) <= max_bits]
        return at[np.bitwise_count(prints[x[at]] ^ prints[y[at]]) <= max_bits]

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    left, right = [], []
    at = np.flatnonzero(np.repeat(sizes <= small, sizes))
    step = 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        pairs = near(at, at + step)
        left.append(at[pairs])
        right.append(at[pairs] + step)
        step += 1
    for lo, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        rest, found = np.arange(lo, lo + n), []
        while len(rest):  # breadth first, so that a group of n gives n - 1 links at most
            if not found:
                found, rest = [rest[0]], rest[1:]
            x = found.pop()
            pairs = near(np.full(len(rest), x), rest)
            left.append(np.full(len(pairs), x))
            right.append(rest[pairs])
            found.extend(rest[pairs])
            rest = np.delete(rest, pairs)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """a and b: links between different values of the column fp that connect all that is connected."""
    masks = block_masks(max_bits + 2)
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    # aggregates are written before rows are joined with them, so that a hot key can be split
    counts = materialise(keyed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    met = keyed.join(counts, ["c", "key"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    met = met.withColumn("own", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = met.select("c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    names = ["c", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(columns[4]), bool)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            a, b = linked(np.cumsum(new), columns[4].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(columns[4][a]), pa.array(columns[4][b])], ["a", "b"])

        for b in batches:
            held = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            last = np.logical_and.reduce([c == c[-1] for c in held[:4]]) if len(held[4]) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if last.any() else 0  # a group may go on in the next batch
            if cut:
                yield found([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if len(held[4]):
            yield found(held)

    return tiles.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id that links lead to: one row for every row of ``docs``.

    A null text counts as empty; texts without words have fingerprint 0 and are linked like any other. Rows that repeat
    an id are rows of their own. Null ids are no smallest id: a group without any id has a null component_id. Texts of any
    length are read whole. An empty table gives an empty result. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, shingle), "prints")
    values = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "values")
    roots = components(links(values.select("fp"), max_bits)).toDF("fp", "root")
    rooted = values.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` of one document of each group: that with the smallest id, and of one id that with the smaller
    hash of its text. Rows without id come last, and one of them stays where a group has no id. Rows that repeat both id
    and text are one document."""

    def own_key(text: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(text), F.lit("")))

    place = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("id"), own_key("text").alias("key"))
    groups = near_groups(docs.select(place.alias("doc_id"), "text"), shingle, max_bits)
    stay = materialise(groups.filter("doc_id <=> component_id").select("doc_id.id", "doc_id.key").distinct().toDF("_id", "_key"), "stay")

    def rows(some: DataFrame) -> DataFrame:
        return packed(some).withColumn("_own", own_key("_row.text"))

    named = rows(docs.filter("doc_id IS NOT NULL")).join(stay.filter("_id IS NOT NULL"), F.expr("_row.doc_id = _id AND _own = _key"))
    nameless = rows(docs.filter("doc_id IS NULL")).dropDuplicates(["_own"])
    nameless = nameless.join(stay.filter("_id IS NULL"), F.expr("_own = _key"))
    return unpacked(named.select("_row").unionAll(nameless.select("_row")))
