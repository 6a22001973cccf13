"""Table profiles: one wide aggregate for statistics, one unpivot for everything about values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators.cleaning import boolean_text, families
from gridlore.operators.quantiles import number, quantiles, wide
from gridlore.session import materialise

# Fixed values of the profile.
TOP_VALUES = 10
COMMON_VALUES = 3
FIRST_VALUES = 8
KEPT_VALUES = 1024  # of a column, in a task's sketch
FEW_DISTINCT = 20
TYPICAL_RANGE_MIN_ROWS = 10
ID_WORDS = ["id", "code", "number", "no"]
DATE_WORDS = ["date", "time"]


def _melt(one_row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """Turn one row with columns ``<i>_<field>`` into one row per profiled column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{f}").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min and max per numeric column, in one pass."""
    columns = columns or families(df)["numeric"]
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [
            F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"),
            F.stddev_samp(x).alias(f"{i}_std"), F.min(x).alias(f"{i}_min"),
            F.max(x).alias(f"{i}_max"),
        ]
    return _melt(df.agg(*aggs), columns, ["count", "mean", "std", "min", "max"])


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Statistics and quartiles per numeric column."""
    columns = columns or families(df)["numeric"]
    quartiles = wide(
        quantiles(df, columns, [0.25, 0.5, 0.75]), {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    )
    return numeric_stats(df, columns).join(quartiles, "column", "left")


def typical_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The middle half of each numeric column that has more than ten values."""
    columns = columns or families(df)["numeric"]
    counts = df.agg(*[F.count(number(c)).alias(f"{i}_count") for i, c in enumerate(columns)])
    filled = _melt(counts, columns, ["count"]).where(F.col("count") > TYPICAL_RANGE_MIN_ROWS)
    quartiles = wide(quantiles(df, columns, [0.25, 0.75]), {0.25: "q25", 0.75: "q75"})
    return filled.join(quartiles, "column").select("column", "count", "q25", "q75")


def missing(df: DataFrame) -> DataFrame:
    """Null count and share per column of the table as loaded, and their total."""
    n = F.count("*")
    numeric = families(df)["numeric"]
    aggs = [n.alias("_rows")]
    for i, c in enumerate(df.columns):
        cell = number(c) if c in numeric else F.col(f"`{c}`")
        aggs.append((n - F.count(cell)).alias(f"{i}_missing"))
    one = df.agg(*aggs)
    total = sum((F.col(f"{i}_missing") for i in range(len(df.columns))), F.lit(0).cast("bigint"))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{i}_missing").alias("missing"),
            (F.col(f"{i}_missing") / F.nullif(F.col("_rows"), F.lit(0)) * 100).alias("missing_pct"),
            total.alias("total_missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def row_digest(df: DataFrame) -> Column:
    """256 bits for a whole row; rows have the same digest if and only if they are equal, nulls counting as equal.

    Every cell is written as text with its length before it, so that no two rows read the same.
    """
    zero = F.lit(0.0)

    def text(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            return (c + zero).cast("string")  # minus zero is zero
        if kind == "binary":
            return F.hex(c)
        if kind in ("array", "map", "struct", "variant"):
            return F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        return c.cast("string")

    cells = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in map(text, df.schema.fields)]
    return F.unhex(F.sha2(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)), 256))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, nulls counting as equal.

    Rows are grouped by a digest, so that what is shuffled does not grow with the width of the table.
    """
    groups = df.select(row_digest(df).alias("_digest")).groupBy("_digest").agg(F.count("*").alias("_n"))
    total, extra = F.sum("_n"), F.sum(F.col("_n") - 1)
    return groups.agg(
        F.coalesce(total, F.lit(0)).alias("rows"),
        F.coalesce(extra, F.lit(0)).alias("duplicates"),
        (extra / F.nullif(total, F.lit(0)) * 100).alias("duplicate_pct"),
    )


def _cells(df: DataFrame, columns: list[str], ordinal: str | None = None) -> DataFrame:
    """(column, value) with values as text, one row per cell that is not null; with the ordinal of its row if asked for."""
    kind = families(df)
    fractional = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def text(c: str) -> Column:
        if c in kind["boolean"]:
            return boolean_text(F.col(f"`{c}`")).alias(c)
        # adding zero makes minus zero zero
        x = number(c) + F.lit(0.0) if c in fractional else F.col(f"`{c}`")
        return x.cast("string").alias(c)

    ids = [F.col(f"`{ordinal}`").alias("_ordinal")] if ordinal else []
    long = df.select(*ids, *[text(c) for c in columns]).unpivot(
        ["_ordinal"] if ordinal else [], [F.col(f"`{c}`") for c in columns], "column", "value"
    )
    return long.where("value IS NOT NULL")


def value_counts(
    df: DataFrame, columns: list[str] | None = None, ordinal: str | None = None
) -> DataFrame:
    """(column, value, n[, first]) with values as text; the one shuffle that value reports share.

    Partial counts shrink a hot value to one row per task before the shuffle. ``first`` is the smallest
    ordinal at which the value occurs.
    """
    columns = columns or df.columns
    numeric = set(families(df)["numeric"])
    aggs = [F.count("*").alias("n")] + ([F.min("_ordinal").alias("first")] if ordinal else [])
    is_number = F.col("column").isin([c for c in columns if c in numeric])
    return _cells(df, columns, ordinal).groupBy("column", "value").agg(*aggs).withColumn("is_number", is_number)


def split_value(counts: DataFrame) -> list[Column]:
    """Values of text columns as ``text`` and of numeric columns as ``number``."""
    return [
        F.when(~F.col("is_number"), F.col("value")).alias("text"),
        F.when(F.col("is_number"), F.col("value")).cast("double").alias("number"),
    ]


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("non_null")
    )


def value_order() -> list[Column]:
    """Numbers by size, text by text: the tie-break between equally common values."""
    return [F.when(F.col("is_number"), F.col("value")).cast("double").asc(), F.col("value").asc()]


def top_values(counts: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), *value_order())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def heavy_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES) -> DataFrame:
    """The same as ``top_values(value_counts(df, columns), n)``, for columns in which a few values are common.

    Every task sums up the values of a column in a sketch of bounded size, which never counts a value too often, and too rarely
    by no more than a known number. The most frequent values of all sketches are then counted exactly in a second scan. If the
    n-th of them is more frequent than any value that was left out can be, they are the answer, and nothing else has been
    shuffled. Columns without such values, as keys, are counted in full.
    """
    columns = columns or df.columns
    kept = KEPT_VALUES
    cells = _cells(df, columns)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {}
        missed: dict[str, int] = {}
        for b in batches:
            counts = pa.Table.from_batches([b]).group_by(["column", "value"]).aggregate([([], "count_all")])
            for column, value, times in zip(*(counts.column(c).to_pylist() for c in ("column", "value", "count_all")), strict=True):
                own = known.setdefault(column, {})
                own[value] = own.get(value, 0) + times
            for column, own in known.items():
                if len(own) > 2 * kept:
                    # what is taken off is what any value can have lost by it
                    cut = sorted(own.values(), reverse=True)[kept]
                    missed[column] = missed.get(column, 0) + cut
                    known[column] = {v: c - cut for v, c in own.items() if c > cut}
        rows = [(c, v, times) for c, own in known.items() for v, times in own.items()] + [(c, None, m) for c, m in missed.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            ["column", "value", "low"],
        )

    sums = cells.mapInArrow(sketched, "column string, value string, low long").groupBy("column", "value").agg(F.sum("low").alias("low"))
    sums = materialise(sums, "value-sketch")
    w = Window.partitionBy("column").orderBy(F.col("low").desc(), "value")
    ranked = sums.where("value IS NOT NULL").withColumn("rank", F.row_number().over(w))
    # so many rows per column at most
    candidates = materialise(ranked.where(F.col("rank") <= kept).select("column", "value"), "value-candidates")
    counted = cells.join(F.broadcast(candidates), ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("n"))
    numeric = [c for c in columns if c in set(families(df)["numeric"])]
    counted = materialise(counted.withColumn("is_number", F.col("column").isin(numeric)), "heavy-values")
    top = top_values(counted, n)
    # a value that is no candidate has at most its count in the sketches, that of the first one left out, and all they can have missed
    others = ranked.where(F.col("rank") == kept + 1).select("column", F.col("low").alias("others"))
    missed = sums.where("value IS NULL").select("column", F.col("low").alias("missed"))
    nth = top.groupBy("column").agg(F.min("n").alias("nth"), F.count("*").alias("found"))
    state = sums.select("column").distinct().join(nth, "column", "left").join(others, "column", "left").join(missed, "column", "left")
    bound = F.coalesce("others", F.lit(0)) + F.coalesce("missed", F.lit(0))
    open_ = state.where((bound > 0) & ((F.coalesce("nth", F.lit(0)) <= bound) | (F.coalesce("found", F.lit(0)) < n))).select("column").collect()  # of the table's columns
    full = {r.column for r in open_}
    rest = [c for c in columns if c in full]
    done = top.where(~F.col("column").isin(rest))
    return done.unionByName(top_values(value_counts(df, rest), n)) if rest else done


def category_share(top: DataFrame) -> DataFrame:
    """Share of each listed value among the listed values of its column."""
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def first_values(counts: DataFrame, n: int = FIRST_VALUES) -> DataFrame:
    """The first n distinct values in row order."""
    w = Window.partitionBy("column").orderBy("first", "value")
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def is_id_like(name: str) -> bool:
    return any(w in name.lower() for w in ID_WORDS)


def key_candidates(df: DataFrame, ordinal: str, counts: DataFrame | None = None) -> DataFrame:
    """Which columns identify rows, group them, or can match records with each other."""
    counts = value_counts(df) if counts is None else counts
    kind = families(df)
    traits = df.sparkSession.createDataFrame(
        [
            (
                c,
                is_id_like(c),
                any(w in c.lower() for w in DATE_WORDS),
            )
            for c in df.columns
        ],
        "column string, id_like boolean, date_name boolean",
    )
    if kind["text"]:
        first = df.agg(
            *[F.min_by(F.col(f"`{c}`"), F.col(f"`{ordinal}`")).alias(f"{i}_first")
              for i, c in enumerate(kind["text"])]
        )
        traits = traits.join(_melt(first, kind["text"], ["first"]), "column", "left")
    else:
        traits = traits.withColumn("first", F.lit(None).cast("string"))
    d = traits.join(distinct_counts(counts), "column", "left").na.fill(0, ["distinct_values", "non_null"])
    unique = F.col("distinct_values") == F.col("non_null")
    dashed = F.coalesce(F.size(F.split("first", "-")) == 3, F.lit(False))
    return d.select(
        "column",
        "distinct_values",
        "non_null",
        "id_like",
        unique.alias("is_unique"),
        (~unique & (F.col("distinct_values") < FEW_DISTINCT)).alias("is_grouping"),
        (F.col("date_name") | dashed).alias("is_match"),
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r for every pair of numeric columns over the rows where both are present.

    Every task adds up products of blocks of rows, all pairs of columns in one matrix product: counts, sums, squares and
    products over the rows where both columns have a cell. Cells are taken from a middle value of their column, found by a
    scan before, so that large offsets cost no digits. A column that is constant where the other is present has no
    correlation (null); so has one whose spread there is below 1e-7 of its distance from that middle value.
    """
    columns = columns or families(df)["numeric"]
    k = len(columns)
    middle = df.agg(*(F.percentile_approx(number(c), 0.5, 100).alias(f"m{i}") for i, c in enumerate(columns))).first() if k else ()
    shift = np.array([m or 0.0 for m in middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            sums, squares = x.T @ m, (x * x).T @ m
            total += [m.T @ m, x.T @ x, sums, sums.T, squares, squares.T]
        at = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()) for a in at] + [pa.array(t[at]) for t in total], ["i", "j", "n", "xy", "x", "y", "xx", "yy"]
        )

    cells = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    sums = cells.mapInArrow(run, "i int, j int, n double, xy double, x double, y double, xx double, yy double")
    sums = sums.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")))
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(square: str, total: str) -> Column:
        own = F.col(square) - F.col(total) * F.col(total) / n
        return F.when(own > F.col(square) * 1e-14, own)

    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread("xx", "x") * spread("yy", "y"))
    names = F.lit(columns)
    return sums.select(F.get(names, "i").alias("x"), F.get(names, "j").alias("y"), r.alias("r"))


def table_shape(df: DataFrame) -> DataFrame:
    kind = families(df)
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        *[F.lit(len(kind[k])).cast("bigint").alias(f"{k}_columns") for k in kind],
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; the last bin includes the maximum."""
    numbers = df.select(number(column).alias("x")).where("x IS NOT NULL")
    bounds = numbers.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")))
    limits = numbers.withColumn("b", bounds.scalar())
    width = (F.col("b.hi") - F.col("b.lo")) / F.lit(bins)
    place = F.coalesce(F.floor((F.col("x") - F.col("b.lo")) / F.nullif(width, F.lit(0.0))), F.lit(0))
    return (
        limits.select(
            F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"),
            F.col("b.lo").alias("lo"),
            width.alias("width"),
        )
        .groupBy("bin", "lo", "width")
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_from"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_to"),
            "n",
        )
    )


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Five numbers, fences at 1.5 inter-quartile ranges, whisker ends and outlier counts per column."""
    columns = columns or families(df)["numeric"]
    d = describe(df, columns)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    d = d.select(
        "column", "min", "q25", "q50", "q75", "max",
        (F.col("q25") - reach).alias("lower_fence"),
        (F.col("q75") + reach).alias("upper_fence"),
    )
    d = materialise(d, "fences")
    fences = {r.column: (r.lower_fence, r.upper_fence) for r in d.collect()}  # one row per column of the table
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        low, high = fences.get(c, (None, None))
        inside = x.between(F.lit(low).cast("double"), F.lit(high).cast("double"))
        aggs += [
            F.min(F.when(inside, x)).alias(f"{i}_lower_whisker"), F.max(F.when(inside, x)).alias(f"{i}_upper_whisker"),
            F.count_if(~inside).alias(f"{i}_outliers"),
        ]
    placed = _melt(df.agg(*aggs), columns, ["lower_whisker", "upper_whisker", "outliers"])
    return d.where("q50 IS NOT NULL").join(placed, "column")


def text_format(column: Column) -> Column:
    """What a text value looks like."""
    text = column.cast("string")
    part = F.split(text, "-")
    size = lambda i: F.length(F.get(part, F.lit(i)))
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    dashed = F.size(part) == 3
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(dashed & (size(0) == 2) & (size(2) == 2), "DD-XXX-YY")
        .when(dashed & (size(0) == 4) & (size(1) == 2) & (size(2) == 2), "YYYY-MM-DD")
        .when(dashed, "other dashed")
        .when(text.contains("@") & text.contains("."), "email-like")
        .when(text.rlike("^[0-9]+$"), "numeric string")
        .when(words == 1, "single word")
        .otherwise("multi-word text")
    )


def format_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of each text format per column, over all values."""
    columns = columns or families(df)["text"]
    formats = df.select(*[text_format(F.col(f"`{c}`")).alias(c) for c in columns])
    cells = formats.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "format")
    counts = cells.where("format IS NOT NULL").groupBy("column", "format").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))
