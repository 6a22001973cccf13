"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when they are identical after each run of ASCII white space has become one space. A text is cut into
chunks of bytes; every chunk gets a polynomial hash for each of several primes, and the hash of the whole is the sum of
its chunks' hashes, each shifted by the number of bytes that follow it. The sum does not care where or in what order the
chunks were hashed, so the chunks of a huge text are spread over tasks. Texts with equal fingerprints are then compared
with their group's first text chunk by chunk in a streaming join; those that differ form groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import packed, unpacked
from gridlore.session import materialise

WHITE_SPACE = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 16
SPREAD_BYTES = 1 << 24  # texts beyond this have their chunks hashed in other tasks as well
MODULI = (2147483629, 2147483587, 2147483579)  # primes below 2**31: a product of two residues fits 64 bits
BASE = 1_000_003
GROUP_MEMBERS = 256  # members compared with one replica of their group's first text


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def powers(count: int, modulus: int) -> np.ndarray:
    """BASE**0 … BASE**(count-1) modulo a prime, by doubling."""
    out = np.ones(max(count, 1), np.uint64)
    done = 1
    while done < count:
        n = min(done, count - done)
        out[done : done + n] = out[:n] * np.uint64(pow(BASE, done, modulus)) % np.uint64(modulus)
        done += n
    return out


def shifted_hashes(chunks: list[bytes], following: list[int], moduli: tuple[int, ...], chunk_bytes: int) -> list[list[int]]:
    """For each modulus the hash of every chunk, shifted by the bytes that follow it in its text."""
    tables = [powers(chunk_bytes, m) for m in moduli]
    out: list[list[int]] = [[] for _ in moduli]
    for chunk, after in zip(chunks, following, strict=True):
        values = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
        for m, table, hashes in zip(moduli, tables, out, strict=True):
            own = int((values * table[: len(values)][::-1]).sum()) % m
            hashes.append(own * pow(BASE, after, m) % m if after else own)
    return out


def _chunk_rows(texts: DataFrame, chunk_bytes: int, *keep: str) -> DataFrame:
    """One row per chunk of the column ``_text``; an empty text has one empty chunk."""
    binary = texts.withColumn("_bytes", F.col("_text").cast("binary")).withColumn("_n", F.length("_bytes"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / chunk_bytes) - 1).cast("int")
    exploded = binary.select(*keep, "_n", "_bytes", F.explode(F.sequence(F.lit(0), last)).alias("_chunk"))
    return exploded.select(
        *keep, "_n", "_chunk", F.substring("_bytes", F.col("_chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("_data")
    )


def _hashed(chunks: DataFrame, moduli: tuple[int, ...], chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, chunk = b.column("_n").to_pylist(), b.column("_chunk").to_pylist()
            after = [max(0, size - (c + 1) * chunk_bytes) for size, c in zip(n, chunk, strict=True)]
            hashes = shifted_hashes(b.column("_data").to_pylist(), after, moduli, chunk_bytes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_sha"), b.column("_n"), b.column("_chunk"), *(pa.array(h, pa.int64()) for h in hashes)],
                ["doc_id", "_sha", "_n", "_chunk", *(f"_h{i}" for i in range(len(moduli)))],
            )

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.mapInArrow(
        run, f"doc_id {kind}, _sha string, _n int, _chunk int, " + ", ".join(f"_h{i} long" for i in range(len(moduli)))
    )


def fingerprints(
    docs: DataFrame, moduli: tuple[int, ...] = MODULI, chunk_bytes: int = CHUNK_BYTES, spread_bytes: int = SPREAD_BYTES
) -> DataFrame:
    """One row per doc_id and normalised text: doc_id, _sha, _n (bytes), _h0 … (fingerprint), _rows (repeated rows).

    Hashes of chunks are added up by Spark, on both sides of the shuffle.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("_text"))
    size = F.octet_length("_text")

    def rows(some: DataFrame) -> DataFrame:
        return _chunk_rows(some.withColumn("_sha", F.sha2("_text", 256)), chunk_bytes, "doc_id", "_sha")

    hashes = _hashed(rows(texts.filter(size <= spread_bytes)), moduli, chunk_bytes)
    huge = rows(texts.filter(size > spread_bytes)).repartition("doc_id", "_chunk")
    parts = hashes.unionAll(_hashed(huge, moduli, chunk_bytes))
    summed = parts.groupBy("doc_id", "_sha", "_n").agg(
        F.sum((F.col("_chunk") == 0).cast("long")).alias("_rows"), *(F.sum(f"_h{i}").alias(f"_h{i}") for i in range(len(moduli)))
    )
    # a repeated row adds the same hashes once more
    whole = {f"_h{i}": F.expr(f"(_h{i} div _rows) % {m}") for i, m in enumerate(moduli)}
    return summed.withColumns(whole)


def differing(docs: DataFrame, groups: DataFrame, keys: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and _sha of the texts that differ from the first text of their group.

    Rows meet members by id and hash of the text, so that rows without id, or of one id, do not all meet each other.
    Members are dealt to replicas of the first text, so that a group of any size spreads over tasks; the join streams
    sorted chunks and holds one chunk of the first text at a time.
    """
    replicas = F.ceil(F.col("_members") / GROUP_MEMBERS).cast("int")
    members = groups.filter("_members > 1").select(
        F.col("doc_id").alias("_id"), F.col("_sha").alias("_s"), *keys, (F.expr("doc_id <=> keep_id AND _sha = _first_sha")).alias("_first"),
        replicas.alias("_replicas"),
    )
    texts = docs.select("doc_id", normalised(F.col("text")).alias("_text"))
    own = texts.withColumn("_own", F.sha2("_text", 256)).join(members, F.expr("doc_id <=> _id AND _own = _s"))
    keep = [k for k in keys if k != "_n"]
    chunks = materialise(_chunk_rows(own.drop("_n"), chunk_bytes, "doc_id", "_s", *keep, "_first", "_replicas"), "candidates")
    # rows that repeat id and text are one member
    first = chunks.filter("_first").dropDuplicates([*keys, "_chunk"]).select(
        *keys, "_chunk", F.col("_data").alias("_first_data"), F.explode(F.sequence(F.lit(0), F.col("_replicas") - 1)).alias("_replica")
    )
    rest = chunks.filter("NOT _first").withColumn("_replica", F.expr("cast(pmod(xxhash64(doc_id, _s), _replicas) as int)"))
    on = [*keys, "_chunk", "_replica"]
    return rest.join(first, on).filter("_data <> _first_data").select("doc_id", F.col("_s").alias("_sha")).distinct()


def exact_groups(docs: DataFrame, moduli: tuple[int, ...] = MODULI, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Group equal texts.

    Returns a row per input row: doc_id, keep_id (smallest doc_id of the group), group_size, kept, text_sha256, n_bytes,
    copy, repeats (rows with this id and text). A null text is an empty one; empty texts are equal to each other. Null ids come last: a group without any id
    has a null keep_id. Of rows that repeat both id and text, the one with copy = 1 stays. Texts of any length are compared whole, chunk
    by chunk. An empty table gives an empty result. Other columns are not read.
    """
    keys = ["_n", *(f"_h{i}" for i in range(len(moduli))), "_round"]
    prints = materialise(fingerprints(docs, moduli, chunk_bytes).withColumn("_round", F.lit(0)), "fingerprints")
    turn = 0
    while True:
        first = prints.groupBy(*keys).agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "_sha")).alias("_f"),
            F.sum("_rows").alias("group_size"), F.count("*").alias("_members"),
        ).select(*keys, F.col("_f.doc_id").alias("keep_id"), F.col("_f._sha").alias("_first_sha"), "group_size", "_members")
        first = materialise(first, "firsts")  # written, so that the join with a hot group can be split
        groups = prints.join(first, keys)
        other = materialise(differing(docs, groups, keys, chunk_bytes), "differing")
        if other.isEmpty():
            break
        # equal fingerprints of different texts: these form groups of their own, compared in the next turn
        turn += 1
        tag = other.select(F.col("doc_id").alias("_i"), F.col("_sha").alias("_s"), F.lit(turn).alias("_turn"))
        marked = prints.join(tag, F.expr("doc_id <=> _i AND _sha = _s"), "left")
        prints = materialise(marked.withColumn("_round", F.coalesce("_turn", "_round")).drop("_i", "_s", "_turn"), "fingerprints")
    copies = groups.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return copies.select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id AND _sha = _first_sha AND copy = 1").alias("kept"),
        F.col("_sha").alias("text_sha256"), F.col("_n").cast("long").alias("n_bytes"), "copy", F.col("_rows").alias("repeats"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one stays."""
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("repeats").alias("_repeats")
    )
    rows = packed(docs).withColumn("_own", F.sha2(normalised(F.col("_row.text")), 256))
    stay = rows.join(kept, F.expr("_row.doc_id <=> _id AND _own = _sha"))
    once, often = stay.filter("_repeats = 1"), stay.filter("_repeats > 1")
    return unpacked(once.select("_row").unionAll(often.dropDuplicates(["_id", "_sha"]).select("_row")))
