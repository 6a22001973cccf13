"""Removal of repeated strings by external induced sorting of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a document with a smaller id or further
up in the same one. Not all suffixes are sorted. As in induced sorting, only those at local minima are, and what lies to the
left of them is induced:

1. *Sample.* Of equal texts the first one stands for all. A suffix is sampled where its first ``GRAM`` bytes rank lowest in some string of ``LENGTH`` bytes. Every such
   string has one sampled suffix, found from its own bytes alone, so equal strings have it at the same place, and the
   strings that share one start at consecutive places to its left.
2. *Sort.* Sampled suffixes whose first bytes occur once cannot lie in a repeated string and drop out. The others become
   tuples of first bytes, the bytes to the right and the bytes to the left. Tuples that agree in all are one tuple from
   then on; its first place stays, the strings of all other places are repeated. Spark sorts the rest by what follows,
   in ranges, with sorted runs on disk that its priority queue merges; neighbours give the longest common prefix.
3. *Induce.* The same tuples are sorted by what precedes, with common prefixes to the left. A string that starts d bytes
   before a sampled suffix can be repeated only if the right prefix is at least ``LENGTH`` - d and the left one at least d
   long. Such strings are induced as new tuples, which a last grouping sends to their first place.

Every step is a sort, a grouping or a join of Spark with spilling operators; a task holds one batch of rows. Groups of
copies of any size are aggregated before they are shuffled. Aggregates are written before rows are joined with them, because
Spark splits a skewed partition only if both sides of a join come straight from a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm.common import discard, written

LENGTH = 100
GRAM = 16
BLOCK = 1 << 19  # bytes whose strings are sampled at a time
BATCH_ROWS = 500  # whose texts are worked on at a time
PLACE_BITS = 20  # of a rank, for the place in the block: of equal bytes, the leftmost is lowest


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on, by doubling; ``gram`` is a power of two."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def lowest(ranks: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` ranks in a row, by doubling."""
    m, have = ranks, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def sampled(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(place, hash, least, most) of sampled suffixes; strings start from ``most`` to ``least`` bytes before the place.

    ``valid`` marks the places from which a whole string starts. Equal bytes give equal samples wherever they stand.
    """
    starts = np.flatnonzero(valid)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    ranks = hashes & ~mask | np.arange(len(hashes), dtype=np.uint64)
    at = (lowest(ranks, length - gram + 1)[starts] & mask).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[new[1:], len(at)] - 1
    place = at[new]
    return place, hashes[place], place - starts[end], place - starts[new]


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together in blocks, long ones in several: bytes, valid starts, and of each part the row, its begin in the
    block and its place in the text."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def block():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        valid = np.ones(len(data), bool)
        for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
            valid[e - min(n, length - 1) : e] = False
        return data, valid, np.array([r for r, _, _ in parts]), ends - sizes, np.array([at for _, at, _ in parts])

    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if parts and held + len(part) > BLOCK + length:
                yield block()
                parts, held = [], 0
            parts.append((row, at, part))
            held += len(part)
    if parts:
        yield block()


def samples(texts: list[bytes], length: int = LENGTH):
    """(row, place in the text, hash, least, most) of all sampled suffixes of the texts, in parts."""
    for data, valid, rows, begins, offsets in blocks(texts, length):
        place, hashes, least, most = sampled(data, valid, length)
        part = np.searchsorted(begins, place, "right") - 1
        yield rows[part], place - begins[part] + offsets[part], hashes.view(np.int64), least, most


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a task holds copies and results of few texts at a time."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, _key (a hash of the text) and text as bytes. Rows that repeat id and text are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_key"), text.cast("binary").alias("_bytes"))


def sampled_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, _key, _n (bytes), _copy and _grams (hashes of the first bytes of sampled suffixes) of every document.

    Whole copies are found first, so that only the first of equal texts goes through the sort: _copy marks the others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "_key", "_other", "_n", "_grams"]
    rows = _texts(docs).withColumn("_other", F.xxhash64(F.lit("other"), "_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            own = b.column("_bytes").to_pylist()
            found = list(samples(own, length))
            none = np.zeros(0, np.int64)
            rows, hashes = (np.concatenate([none, *(x[i] for x in found)]) for i in (0, 2))
            offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(own)))]
            grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))
            sizes = pa.array([len(t) for t in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), b.column("_other"), sizes, grams], names)

    each = written(rows.mapInArrow(run, f"doc_id {kind}, _key long, _other long, _n long, _grams array<long>"), "sampled")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id")).alias("_first")
    firsts = written(each.groupBy("_key", "_other").agg(least), "firsts", "snappy")
    marked = each.join(firsts, ["_key", "_other"]).withColumn("_copy", ~F.col("doc_id").eqNullSafe(F.col("_first.doc_id")))
    out = written(marked.select("doc_id", "_key", "_n", "_copy", F.when(~F.col("_copy"), F.col("_grams")).alias("_grams")), "documents")
    discard(each, firsts)
    return out


def repeated_grams(sampled_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, _key and _grams: of every document that is no copy, the hashes that occur more than once. And the written
    table of those hashes, which the first reads."""
    each = sampled_.filter("NOT _copy").select("doc_id", "_key", F.explode("_grams").alias("gram"))
    often = each.groupBy("gram").count().filter("count > 1").select("gram")
    often = written(often, "often", "snappy")
    return each.join(often, "gram").groupBy("doc_id", "_key").agg(F.collect_set("gram").alias("_grams")), often


TUPLE = "gram long, c1 long, c2 long, least int, most int, doc_id {kind}, _key long, at long, right binary, left binary"


def tuples(docs: DataFrame, grams: DataFrame, length: int = LENGTH) -> DataFrame:
    """The tuple of every sampled suffix whose first bytes occur more than once.

    gram (hash of the first bytes), c1 and c2 (a digest of right, left, least and most), least, most, doc_id, _key, at (its
    place), right (bytes from the place on, as far as its strings go) and left (bytes before it, the nearest first).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = grams.withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k")
    rows = _texts(docs).join(lists, F.expr("doc_id <=> _id AND _key = _k")).select("doc_id", "_key", "_bytes", "_grams")
    names = [c.split()[0] for c in TUPLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            own = b.column("_bytes").to_pylist()
            known = [np.sort(np.asarray(g.as_py(), np.int64)) for g in b.column("_grams")]
            for rows, places, hashes, least, most in samples(own, length):
                edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
                keep = np.concatenate(
                    [np.isin(h, known[rows[e]]) for e, h in zip(edges, np.split(hashes, edges[1:]), strict=True)] or [np.zeros(0, bool)]
                )
                out: tuple[list, ...] = ([], [], [], [])
                for r, p, lo, hi in zip(*(x[keep].tolist() for x in (rows, places, least, most)), strict=True):
                    context = own[r][p - hi : p - lo + length]
                    digest = hashlib.blake2b(context, digest_size=16, salt=b"%d,%d" % (lo, hi)).digest()
                    out[0].append(int.from_bytes(digest[:8], "little", signed=True))
                    out[1].append(int.from_bytes(digest[8:], "little", signed=True))
                    out[2].append(context[hi:])
                    out[3].append(context[:hi][::-1])
                of = pa.array(rows[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[keep]), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(least[keep], pa.int32()),
                     pa.array(most[keep], pa.int32()), b.column("doc_id").take(of), b.column("_key").take(of), pa.array(places[keep]),
                     pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                    names,
                )

    return rows.mapInArrow(run, TUPLE.format(kind=kind))


def _padded(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)


def common_prefixes(gram: np.ndarray, values: list[bytes], width: int) -> np.ndarray:
    """The longest prefix that each of some sorted values shares with a neighbour of the same first bytes.

    The first and the last may have neighbours that are not here: theirs counts as ``width``.
    """
    table, sizes = _padded(values, width), np.fromiter(map(len, values), np.int64, len(values))
    differ = table[1:] != table[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1])) * (gram[1:] == gram[:-1])
    return np.maximum(np.r_[width, shared], np.r_[shared, width])


def _sorted_with(tuples_: DataFrame, first: str, second: str, name: str, length: int) -> DataFrame:
    """Adds the longest prefix of the column ``first`` that a tuple shares with any other of the same gram."""
    order = ["gram", first, second]
    schema = T.StructType([*tuples_.schema, T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = common_prefixes(b.column("gram").to_numpy(), b.column(first).to_pylist(), length)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared, pa.int32())], [*b.schema.names, name])

    return tuples_.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def induced(tuples_: DataFrame, length: int = LENGTH) -> DataFrame:
    """w1, w2 (digest of a string), doc_id, _key, at: the strings that may be repeated, from tuples with both prefixes."""
    kind = tuples_.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("least", "most", "shared_right", "shared_left", "left", "right", "at")}
            row, at, w1, w2 = [], [], [], []
            for i, (lo, hi, r, lf, left, right, place) in enumerate(zip(*cols.values(), strict=True)):
                context = left[::-1] + right
                for d in range(max(lo, length - r), min(hi, lf) + 1):
                    digest = hashlib.blake2b(context[hi - d : hi - d + length], digest_size=16).digest()
                    row.append(i)
                    at.append(place - d)
                    w1.append(int.from_bytes(digest[:8], "little", signed=True))
                    w2.append(int.from_bytes(digest[8:], "little", signed=True))
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), b.column("doc_id").take(of), b.column("_key").take(of), pa.array(at, pa.int64())],
                ["w1", "w2", "doc_id", "_key", "at"],
            )

    return tuples_.mapInArrow(run, f"w1 long, w2 long, doc_id {kind}, _key long, at long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, _key, start, end: spans of bytes, overlapping ones too, that cover all that is to go."""
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "_key", "at")
    not_first = ~place.eqNullSafe(F.col("first"))
    span = ["doc_id", "_key", "start", "end"]

    own = sampled_documents(docs, length)
    grams, often = repeated_grams(own)
    found = written(tuples(docs, grams, length), "tuples")
    copies = written(own.filter(F.col("_copy") & (F.col("_n") >= length)).selectExpr("doc_id", "_key", "0L AS start", "_n AS end"), "copies")
    discard(own, often)

    same = found.groupBy("gram", "c1", "c2").agg(F.min(place).alias("first"))
    same = written(same, "same", "snappy")
    several = written(same.groupBy("gram").agg(F.count("*").alias("kinds")), "several", "snappy")
    each, same = same, written(same.join(several, "gram").select("c1", "c2", "first", "kinds"), "kinds")
    discard(each, several)
    again = found.drop("left", "right").join(same.drop("kinds"), ["c1", "c2"]).filter(not_first)
    again = again.withColumns({"start": F.col("at") - F.col("most"), "end": F.col("at") - F.col("least") + length})
    again = written(again.select(*span), "repeated-tuples")
    kept = found.join(same.filter("kinds > 1").drop("kinds"), ["c1", "c2"]).filter(~not_first).drop("c1", "c2", "first")
    kept = written(kept, "sample")
    discard(found, same)

    by_right = written(_sorted_with(kept, "right", "left", "shared_right", length), "by-right")
    discard(kept)
    by_left = _sorted_with(by_right.filter(F.col("shared_right") + F.col("most") >= length), "left", "right", "shared_left", length)
    strings = written(induced(by_left, length), "strings")
    discard(by_right)
    firsts = strings.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "first-strings", "snappy")
    later = strings.join(firsts, ["w1", "w2"]).filter(not_first)
    later = written(later.select("doc_id", "_key", F.col("at").alias("start"), (F.col("at") + length).alias("end")), "repeated-strings")
    discard(strings, firsts)
    return copies.unionAll(again).unionAll(later)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left): a row for every row of ``docs``.

    A null text counts as empty; texts shorter than ``length`` bytes stay whole. Null ids come last. Rows that repeat id and
    text are one document; rows that repeat an id with other texts follow each other in a fixed order. Strings are judged on
    the input, overlaps count, and none crosses documents. Long texts are cut into overlapping blocks. An empty table gives an
    empty result. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length).groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(
        F.collect_list(F.col("start")).alias("_starts"), F.collect_list(F.col("end")).alias("_ends")
    )
    rows = _texts(docs).join(spans, F.expr("doc_id <=> _id AND _key = _k"), "left").select("doc_id", "_bytes", "_starts", "_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, starts, ends in zip(*(b.column(c) for c in ("_bytes", "_starts", "_ends")), strict=True):
                data, left, n = text.as_py(), [], 0
                pos = 0
                if starts.is_valid:
                    order = np.argsort(s := np.asarray(starts.values), kind="stable")
                    s, e = s[order], np.maximum.accumulate(np.asarray(ends.values)[order])
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])  # touching spans are one
                    for lo, hi in zip(s[new].tolist(), np.r_[e[new[1:] - 1], e[-1]].tolist(), strict=True):
                        left.append(data[pos:lo])
                        pos, n = hi, n + 1
                kept = b"".join([*left, data[pos:]])
                for column, x in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
