"""Exact top-k search by inner product with MaxScore.

A vector's components are the terms of a document, turned into whole numbers. In a shard of vectors each term has a posting
list, one value per vector, and its largest and smallest value bound what it can add to a score. For a query, the terms of
least reach whose reaches together stay below the score to be beaten are non-essential. Essential postings are traversed
for all vectors of the shard; the others are probed, in order of their reach, only for vectors that can still compete.
Query blocks meet shards of bounded size, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.session import materialise

K = 5
SCALE = 256
SHARD = 4096  # vectors of one shard
BLOCK = 4096  # queries of one block
PROBES = 8  # non-essential terms probed before candidates are looked through again
FIRST = 512  # vectors scored in full to learn the score to be beaten


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def max_score(queries: np.ndarray, postings: np.ndarray, k: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query the places and scores of its k best vectors, all that tie with the last of them included.

    ``queries`` has a row per query, ``postings`` a row per term and a column per vector. Sums are exact: they are whole
    numbers, in floating point only while every sum stays below the last whole number that it can hold.
    """
    terms, n = postings.shape
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(postings).max(initial=0)) * terms
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    q, p = queries.astype(kind), np.ascontiguousarray(postings.astype(kind))
    high, low = p.max(axis=1, initial=-reach), p.min(axis=1, initial=reach)
    learnt = q @ p[:, :FIRST]
    out = []
    for query, first, want in zip(q, learnt, k, strict=True):
        beat = _kth(first, want) if len(first) >= want else -reach - 1
        most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
        order = np.argsort(least - most, kind="stable")  # terms of most reach first
        rest_most = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from a place on can add
        rest_least = np.append(np.cumsum(least[order][::-1])[::-1], 0)
        worst = rest_least[0] - rest_least
        # non-essential: the terms whose best, with the worst of those before them, does not reach the score to be beaten
        hopeless = worst + rest_most < beat
        done = max(1, int(np.argmax(hopeless))) if hopeless.any() else terms
        score, at = query[order[:done]] @ p[order[:done]], np.arange(n)
        while done < terms:
            if len(score) >= want:
                beat = max(beat, _kth(score, want) + rest_least[done])
            stay = np.flatnonzero(score + rest_most[done] >= beat)
            lists = order[done : done + PROBES]
            done += len(lists)
            at = at[stay]
            score = score[stay] + query[lists] @ p[np.ix_(lists, at)]
        if len(score) > want:
            stay = np.flatnonzero(score >= _kth(score, want))
            at, score = at[stay], score[stay]
        out.append((at, score.astype(np.int64)))
    return out


def search(vectors: DataFrame, k: int = K, every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id, null last. Vectors that are null or hold null or non-finite components take no part.
    A query meets vectors of its own length only; empty vectors score 0. Rows that repeat a vec_id are the query's own for
    a query of that id and candidates of their own for others; a query row that repeats id and vector is asked once. An empty
    table gives an empty result; other columns are not read.
    """
    whole = vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v")).filter("v IS NOT NULL")
    # numbered, so that rows without id, or of one id, are dealt like any others
    rows = materialise(whole.withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "size").dropDuplicates(["vec_id", "v"])
    asked = asked.withColumn("key", F.xxhash64("vec_id", "v"))
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, SHARD), (asked, BLOCK)))

    def numbered(name: str, of: str, n: int):
        return F.pmod(F.xxhash64(of, F.lit(name)), F.lit(n)).cast("int").alias(name)

    def all_of(name: str, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    # queries are the smaller side: every block goes to every shard, and a shard is repeated only for further blocks
    left = asked.select("*", numbered("block", "key", blocks), all_of("shard", shards)).groupBy("size", "block", "shard")
    right = rows.select("vec_id", "v", "size", numbered("shard", "row", shards), all_of("block", blocks)).groupBy("size", "block", "shard")

    def best(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: tuple[list[np.ndarray], ...] = ([], [], [], [])
        if len(queries) and len(shard):
            shard = shard.take(pyarrow.compute.sort_indices(shard, [("vec_id", "ascending")]))  # null comes last
            ids, size = shard.column("vec_id"), queries.column("size")[0].as_py()
            known = ids.to_numpy(zero_copy_only=False)[: len(ids) - ids.null_count].astype(np.int64)

            def matrix(t: pa.Table) -> np.ndarray:
                return t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), size)

            query_ids, keys = queries.column("vec_id").to_numpy(), queries.column("key").to_numpy()
            lo, hi = np.searchsorted(known, query_ids, "left"), np.searchsorted(known, query_ids, "right")
            wanted = np.minimum(len(ids), k + hi - lo).tolist()
            found = max_score(matrix(queries), matrix(shard).T, wanted)
            for q, (at, score) in enumerate(found):
                other = (at < lo[q]) | (at >= hi[q])
                at, score = at[other], score[other]
                top = np.lexsort((at, -score))[:k]
                for column, x in zip(out, (np.full(len(top), query_ids[q]), np.full(len(top), keys[q]), at[top], score[top]), strict=True):
                    column.append(x)
        none = np.zeros(0, np.int64)
        query_id, key, at, score = (np.concatenate([none, *c]) for c in out)
        vec_id = shard.column("vec_id").combine_chunks().take(pa.array(at)) if len(at) else pa.array([], pa.int64())
        return pa.table({"query_id": query_id, "key": key, "vec_id": vec_id, "score": score})

    found = left.cogroup(right).applyInArrow(best, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
