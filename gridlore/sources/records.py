"""Records of text files whose borders depend on everything before them, read by many tasks.

A line break ends a CSV record only outside quotes, and a brace ends an element of a JSON array only outside strings and at
the right depth. Files are read in byte ranges all the same. A first pass sums up each range: whether it turns quoting
around, and by how much it changes the depth, for either state at its start. Running sums over the ranges, one row each, give
the state at every start. The second pass cuts each range into records; what a range leaves open is put together with the
beginnings of those that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.session import materialise

JSON, CSV = "}", "\n"  # what files are cut at before it is known where a record ends


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file, start (of the byte range) and value: the text up to every mark, in order within each range."""
    text = spark.read.option("lineSep", mark).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _reader(mark: str):
    """Two functions of Arrow batches: (file, start, value) to a row that sums up each range, and the same with the state at
    the start of the range to its records and what is left open."""
    end, json = mark.encode(), mark == JSON

    def runs(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """The rows of one range after the other."""
        file, start = b.column("file").dictionary_encode().indices.to_numpy(), b.column("start").to_numpy()
        new = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])])
        yield from zip(new.tolist(), [*new[1:].tolist(), len(b)], strict=True)

    def bytes_of(b: pa.RecordBatch, lo: int, hi: int) -> bytes:
        return end.join([*(v.as_py().encode() for v in b.column("value")[lo:hi]), b""])

    def quotes(data: np.ndarray) -> np.ndarray:
        """Which bytes begin or end a quoted part. Data end with a mark, so that no backslash reaches over their end."""
        found = data == ord('"')
        if json:
            place = np.arange(len(data))
            other = np.maximum.accumulate(np.where(data != ord("\\"), place, -1))
            at = np.flatnonzero(found)
            before = np.where(at > 0, other[at - 1], -1)
            found[at] = (at - 1 - before) % 2 == 0  # an even number of backslashes before it
        return found

    def nesting(data: np.ndarray) -> np.ndarray:
        if not json:
            return np.zeros(len(data), np.int64)
        opens, closes = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
        return opens.astype(np.int64) - closes

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        now, turned, plain, quoted = None, 0, 0, 0

        def close() -> None:
            if now is not None:
                for column, x in zip(out, (*now, turned, plain, quoted), strict=True):
                    column.append(x)

        for b in batches:
            for lo, hi in runs(b):
                this = (b.column("file")[lo].as_py(), b.column("start")[lo].as_py())
                if this != now:
                    close()
                    now, turned, plain, quoted = this, 0, 0, 0
                data = np.frombuffer(bytes_of(b, lo, hi), np.uint8)
                inside = (np.cumsum(quotes(data)) + turned) % 2 == 1
                change = nesting(data)
                plain, quoted = plain + int(change[~inside].sum()), quoted + int(change[inside].sum())
                turned = int(inside[-1])
        close()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["file", "start", "turned", "plain", "quoted"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """file, start, place and record. Place is 0 for what ends a record from before, 1 for a whole record, 2 for one that is
        open at the end, 3 for a range that is open all through, 4 for the first record of a CSV file."""
        now, inside_at, depth, pending, place, first = None, 0, 0, b"", 1, False

        def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array([p for p, _ in found], pa.int32()),
                 pa.array([r.decode() for _, r in found], pa.string())],
                ["file", "start", "place", "record"],
            )

        for b in batches:
            for lo, hi in runs(b):
                this = (b.column("file")[lo].as_py(), b.column("start")[lo].as_py())
                if this != now:
                    if now is not None and pending:
                        yield rows([(place if place == 3 else 2, pending)])
                    now, inside_at, depth = this, b.column("inside")[lo].as_py(), b.column("depth")[lo].as_py()
                    carried = inside_at == 1 or depth >= 2
                    pending, place, first = b"", 3 if carried else 1, not json and this[1] == 0
                text = bytes_of(b, lo, hi)
                data = np.frombuffer(text, np.uint8)
                inside = (np.cumsum(quotes(data)) + inside_at) % 2 == 1
                outside = ~inside
                if json:
                    depths = np.cumsum(np.where(outside, nesting(data), 0)) + depth
                    begins = np.flatnonzero(outside & (data == ord("{")) & (depths == 2))
                    ends = np.flatnonzero(outside & (data == ord("}")) & (depths == 1)) + 1
                    depth = int(depths[-1])
                else:
                    ends = np.flatnonzero(outside & (data == ord("\n"))) + 1
                    begins = np.r_[0, ends] if not pending and place != 3 else ends
                    begins = begins[begins < len(data)]
                inside_at = int(inside[-1])
                found = []
                at = None if not pending and place != 3 else 0  # where the open record goes on
                i = j = 0
                while True:
                    if at is None:
                        if i == len(begins):
                            break
                        at, i = int(begins[i]), i + 1
                    while j < len(ends) and ends[j] <= at:
                        j += 1
                    if j == len(ends):
                        pending += text[at:]
                        break
                    found.append((0 if place == 3 else 4 if first else 1, pending + text[at : ends[j]]))
                    pending, place, at, first = b"", 1, None, False
                    while i < len(begins) and begins[i] < ends[j]:
                        i += 1
                if found:
                    yield rows(found)
        if now is not None and pending:
            yield rows([(place if place == 3 else 2, pending)])

    return summed, cut


def split_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file, start, place and record: every record of the files, as its text. Place 4 marks the first record of a CSV file.

    ``mark`` is JSON for files that hold one array of objects each, CSV for files with quotes, doubled inside a cell. A task
    holds one record and one batch of pieces. The table of ranges, one row per range of some MB, is sent to all tasks.
    """
    pieces = _pieces(spark, path, mark)
    summed, cut = _reader(mark)
    ranges = pieces.mapInArrow(summed, "file string, start long, turned int, plain long, quoted long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = ranges.withColumn("inside", (F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2).cast("int"))
    ranges = ranges.withColumn("change", F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain")))
    ranges = ranges.select(
        F.col("file").alias("_file"), F.col("start").alias("_start"), "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")
    )
    known = pieces.join(F.broadcast(ranges), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    found = known.select("file", "start", "value", "inside", "depth").mapInArrow(cut, "file string, start long, place int, record string")
    found = materialise(found, "records")
    # an open record is numbered by the open ends up to it, and goes on through ranges that are open all through
    upto = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = found.where("place IN (0, 2, 3)").withColumn("number", F.sum(F.when(F.col("place") == 2, 1).otherwise(0)).over(upto))
    joined = parts.groupBy("file", "number").agg(
        F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "start", F.when(F.col("place") == 2, 1).otherwise(0).alias("order"), "record"
        ))), lambda p: p["record"]), "").alias("record"),
    )
    return found.where("place IN (1, 4)").unionByName(joined.select("file", "start", F.lit(2).alias("place"), "record"))
