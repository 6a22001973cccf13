"""Profile chunks: what a table looks like, as texts that questions can be matched with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators import profile as P
from gridlore.operators.cleaning import boolean_text, display_cell, families
from gridlore.operators.quantiles import quantiles, wide
from gridlore.session import materialise
from gridlore.sources.tables import sample_rows

# ---- fixed values: layout of the chunk texts -----------------------------------------------------
RULE = "=" * 50
SCHEMA_TITLE = "SCHEMA INFORMATION:"
SCHEMA_COLUMNS_TITLE = "Columns and their data types:"
NUMERIC_TITLE = "NUMERICAL COLUMNS STATISTICS:"
TEXT_TITLE = "CATEGORICAL COLUMN: "
TOP_TITLE = "Top values and their counts:"
SAMPLES_TITLE = "DATASET SCHEMA AND SAMPLE VALUES:"
INSIGHTS_TITLE = "QUERY-FOCUSED DATA INSIGHTS:"
NUMERIC_USE = "Use for: Calculations (SUM, AVG), Comparisons (>, <), Aggregation"
TEXT_USE = "Use for: Text matching (LIKE), Grouping, Filtering"
SHAPE_TEXT = "Dataset has %d rows and {width} columns"
COLUMN_LINE = "  - %s: %s (%d missing values)\n"
STATISTICS = (("Mean", "mean"), ("Std", "std"), ("Min", "min"), ("Max", "max"))
TOP_LINE = "  - %s: %d\n"
COLUMN_LABEL = "Column: "
TYPE_LABEL = "  Type: "
SAMPLES_LABEL = "  Sample values: "
RANGE_LABEL = "  Range: "
COMMON_LABEL = "\n  Common values: "
ROWS_TITLE = "DATA ROWS (First %d rows):"
ID_SAMPLES_LABEL = " samples: "
AVERAGE_LABEL = " (avg: "
ID_COLUMNS_LABEL = "ID/Key columns: "
NUMERIC_COLUMNS_LABEL = "Numeric filter columns: "
TEXT_COLUMNS_LABEL = "\nText filter columns: "
VALUES_FROM = "Range: Values from "
TYPICAL_LABEL = "Typical range (25-75%): "
NUMERIC_TYPE = "Type: Numeric"
TEXT_TYPE = "Type: Text"
DISTINCT_NUMBERS = "Contains: Distinct numeric values"
FORMAT_LABEL = "Format: "
UNIQUE_LINE = "\nUnique values: %d"
MISSING_LINE = "Missing values: %d"
FORMAT_TEXTS = {
    "DD-XXX-YY": "DD-XXX-YY (date-like)",
    "YYYY-MM-DD": "YYYY-MM-DD (date-like)",
    "email-like": "Contains @ and . (email-like)",
    "numeric string": "Numeric string",
    "single word": "Single word",
    "multi-word text": "Multi-word text",
}
TYPE_NAMES = {"integer": "int64", "fraction": "float64", "boolean": "bool", "text": "object", "datetime": "datetime64[ns]"}
SAMPLE_ROWS = 5
ID_SAMPLES = 5
# ---- end of fixed values -------------------------------------------------------------------------


def fixed(column: Column, digits: int) -> Column:
    """A number with a fixed number of digits, half-even on its exact value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", column, F.lit(pattern))


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return TYPE_NAMES["integer"]
    if isinstance(kind, T.NumericType):
        return TYPE_NAMES["fraction"]
    if isinstance(kind, T.BooleanType):
        return TYPE_NAMES["boolean"]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TYPE_NAMES["datetime"]
    return TYPE_NAMES["text"]


def column_profile(df: DataFrame, key: str) -> DataFrame:
    """One row per column: type, counts, statistics, top and first values; ``key`` orders the rows."""
    spark = df.sparkSession
    kind = families(df)
    numeric, text = set(kind["numeric"]), set(kind["text"])
    base = spark.createDataFrame(
        [
            (i, f.name, type_name(f.dataType), f.name in numeric, f.name in text, P.is_id_like(f.name))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, is_numeric boolean, is_text boolean, id_like boolean",
    )
    counts = materialise(P.value_counts(df, ordinal=key), "value-counts")
    top = P.top_values(counts).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top")
    )
    first = P.first_values(counts).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position").alias("place"), "value"))).alias("first")
    )
    out = (
        base.join(P.missing(df).select("column", "missing"), "column", "left")
        .join(P.distinct_counts(counts), "column", "left")
        .join(top, "column", "left")
        .join(first, "column", "left")
        .na.fill(0, ["distinct_values", "non_null"])
    )
    if numeric:
        quartiles = wide(quantiles(df, kind["numeric"], [0.25, 0.75]), {0.25: "q25", 0.75: "q75"})
        stats = P.numeric_stats(df, kind["numeric"]).drop("count")
        out = out.join(stats, "column", "left").join(quartiles, "column", "left")
    else:
        for c in ("mean", "std", "min", "max", "q25", "q75"):
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out


def _lines(*parts: Column | str) -> Column:
    """Parts one below the other, each closed by a line break; null parts are left out."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.concat_ws("\n", *cols), F.lit("\n"))


def _gather(columns: DataFrame, text: Column, sep: str = "") -> Column:
    """The texts of all columns of the table in column order; one short row per column."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("position"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda r: r["t"]), sep)


def _joined(rows: Column, n: int, sep: str = ", ") -> Column:
    return F.array_join(F.transform(F.slice(rows, 1, n), lambda r: r["value"]), sep)


def profile_chunks(df: DataFrame, key: str, shown: int | None = None) -> DataFrame:
    """The chunk table of a table: chunk_id, ordinal, type, column, content.

    Lists of columns name all columns, or the first ``shown`` of each kind.

    All texts are put together from the column profile, which has one row per column, and from the first
    rows; no step handles the rows of the table again.
    """
    profile = materialise(column_profile(df, key), "column-profile")
    rows = df.select(F.count("*")).scalar()
    width = len(df.columns)
    parts = [
        _schema_chunk(profile, rows, width),
        _numeric_chunk(profile),
        _text_chunks(profile),
        _samples_chunk(profile),
        _rows_chunk(df, key, shown),
        _insights_chunk(profile, shown),
        _column_chunks(profile),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    w = Window.orderBy("group", "position")  # a few rows per column of the table
    return out.where("content IS NOT NULL").select(
        "chunk_id",
        (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"),
        "type",
        "column",
        "content",
    )


def _one(df: DataFrame, group: int, kind: str, chunk_id: str, content: Column) -> DataFrame:
    return df.agg(content.alias("content")).select(
        F.lit(group).alias("group"),
        F.lit(0).alias("position"),
        F.lit(chunk_id).alias("chunk_id"),
        F.lit(kind).alias("type"),
        F.lit(None).cast("string").alias("column"),
        "content",
    )


def _schema_chunk(profile: DataFrame, rows: Column, width: int) -> DataFrame:
    line = F.format_string(COLUMN_LINE, "column", "dtype", "missing")
    title = f"{SCHEMA_TITLE}\n{SHAPE_TEXT.format(width=width)}\n{SCHEMA_COLUMNS_TITLE}\n"
    head = F.format_string(title, F.first(rows))
    return _one(profile, 0, "schema", "schema_0", F.concat(head, _gather(profile, line)))


def _numeric_chunk(profile: DataFrame) -> DataFrame:
    numeric = profile.where("is_numeric")
    stats = [
        F.concat(F.lit(f"  {name}: "), F.coalesce(fixed(F.col(c), 2), F.lit("nan")))
        for name, c in STATISTICS
    ]
    block = F.concat(F.lit("\n"), F.col("column"), F.lit(":\n"), _lines(*stats))
    content = F.when(F.count("*") > 0, F.concat(F.lit(f"{NUMERIC_TITLE}\n"), _gather(numeric, block)))
    return _one(numeric, 1, "statistics", "stats_numerical", content)


def _text_chunks(profile: DataFrame) -> DataFrame:
    top = F.transform("top", lambda t: F.format_string(TOP_LINE, t["value"], t["n"]))
    return profile.where("is_text").select(
        F.lit(2).alias("group"),
        "position",
        F.concat(F.lit("stats_"), F.col("column")).alias("chunk_id"),
        F.lit("statistics").alias("type"),
        "column",
        F.concat(
            F.lit(TEXT_TITLE), F.col("column"), F.lit(f"\n{TOP_TITLE}\n"),
            F.coalesce(F.array_join(top, ""), F.lit("")),
        ).alias("content"),
    )


def _samples_chunk(profile: DataFrame) -> DataFrame:
    listed = F.col("is_text") | (F.col("distinct_values") < P.FEW_DISTINCT)
    samples = F.when(
        listed & (F.size("first") > 0),
        F.concat(F.lit(SAMPLES_LABEL), _joined(F.col("first"), P.FIRST_VALUES)),
    )
    spread = F.when(
        ~listed & F.col("is_numeric"),
        F.concat(
            F.lit(RANGE_LABEL), fixed(F.col("min"), 2), F.lit(" to "), fixed(F.col("max"), 2),
            F.lit(COMMON_LABEL), _joined(F.col("top"), P.COMMON_VALUES),
        ),
    )
    block = F.concat(
        _lines(
            F.concat(F.lit(COLUMN_LABEL), F.col("column")),
            F.concat(F.lit(TYPE_LABEL), F.col("dtype")),
            samples,
            spread,
        ),
        F.lit("\n"),
    )
    content = F.concat(F.lit(f"{SAMPLES_TITLE}\n{RULE}\n\n"), _gather(profile, block))
    return _one(profile, 3, "schema_samples", "schema_with_samples", content)


def _rows_chunk(df: DataFrame, key: str, columns: int | None) -> DataFrame:
    shown = df.columns[:columns]
    booleans = families(df)["boolean"]

    def cell(c: str) -> Column:
        x = boolean_text(F.col(f"`{c}`")) if c in booleans else F.col(f"`{c}`")
        return F.coalesce(display_cell(x), display_cell(F.lit("nan")))

    cells = F.array(*[cell(c) for c in shown])
    head = " | ".join(f"{c:<15}"[:15] for c in shown) + "\n" + "-" * (len(shown) * 16) + "\n"
    few = sample_rows(df, key, SAMPLE_ROWS).select(
        F.col(f"`{key}`").alias("position"), F.array_join(cells, " | ").alias("line")
    )
    body = _gather(few, F.concat(F.col("line"), F.lit("\n")))
    title = F.format_string(f"{ROWS_TITLE}\n{RULE}\n\n", F.count("*"))
    return _one(few, 4, "data_rows", "data_rows_table", F.concat(title, F.lit(head), body))


def _insights_chunk(profile: DataFrame, shown: int | None) -> DataFrame:
    most = F.lit(2**31 - 1 if shown is None else shown)
    by_position = Window.orderBy("position")  # one row per column of the table

    def place(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), 1).otherwise(0)).over(by_position)

    p = profile.select(
        "*",
        place("id_like").alias("id_place"),
        place("is_numeric").alias("number_place"),
        place("is_text").alias("text_place"),
    )

    def names(flag: str, place_column: str | None = None) -> Column:
        named = F.col(flag) & (F.col(place_column) <= most) if place_column else F.col(flag)
        picked = F.array_sort(F.collect_list(F.when(named, F.struct("position", "column"))))
        return F.array_join(F.transform(picked, lambda r: r["column"]), ", ")

    def texts(shown: Column, text: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(shown, F.struct(F.col("position"), text.alias("t")))))
        return F.array_join(F.transform(picked, lambda r: r["t"]), "")

    id_samples = texts(
        F.col("id_like") & (F.col("id_place") <= most),
        F.concat(
            F.lit("  "), F.col("column"), F.lit(ID_SAMPLES_LABEL),
            F.coalesce(_joined(F.col("first"), ID_SAMPLES), F.lit("")), F.lit("\n"),
        ),
    )
    ranges = texts(
        F.col("is_numeric") & (F.col("number_place") <= most) & (F.col("non_null") > 0),
        F.concat(
            F.lit("  "), F.col("column"), F.lit(": "), fixed(F.col("min"), 0), F.lit(" to "),
            fixed(F.col("max"), 0), F.lit(AVERAGE_LABEL), fixed(F.col("mean"), 0), F.lit(")\n"),
        ),
    )
    common = texts(
        F.col("is_text") & (F.col("text_place") == 1),
        F.concat(
            F.lit("  Common '"), F.col("column"), F.lit("' values: "),
            F.coalesce(_joined(F.col("top"), P.COMMON_VALUES), F.lit("")), F.lit("\n"),
        ),
    )

    def if_any(flag: str, text: Column) -> Column:
        return F.when(F.count_if(F.col(flag)) > 0, text).otherwise("")

    content = F.concat(
        F.lit(f"{INSIGHTS_TITLE}\n{RULE}\n\n"),
        if_any("id_like", F.concat(F.lit(ID_COLUMNS_LABEL), names("id_like"), F.lit("\n\n"), id_samples, F.lit("\n"))),
        if_any("is_numeric", F.concat(F.lit(NUMERIC_COLUMNS_LABEL), names("is_numeric"), F.lit("\n\n"), ranges)),
        if_any("is_text", F.concat(
            F.lit(TEXT_COLUMNS_LABEL), names("is_text", "text_place"), F.lit("\n"), common)),
    )
    return _one(p, 5, "query_insights", "query_focused", content)


def _column_chunks(profile: DataFrame) -> DataFrame:
    some = F.col("non_null") > 0
    look = P.text_format(F.get(F.transform("first", lambda f: f["value"]), F.lit(0)))
    named = F.create_map(*[F.lit(x) for pair in FORMAT_TEXTS.items() for x in pair])
    span = F.concat(
        F.lit(VALUES_FROM), fixed(F.col("min"), 0), F.lit(" to "), fixed(F.col("max"), 0)
    )
    typical = F.concat(
        F.lit(TYPICAL_LABEL), fixed(F.col("q25"), 0), F.lit(" to "), fixed(F.col("q75"), 0)
    )
    content = F.concat(
        _lines(
            F.concat(F.lit(COLUMN_LABEL), F.col("column")),
            F.when(F.col("is_numeric"), F.lit(f"{NUMERIC_TYPE}\n{NUMERIC_USE}")),
            F.when(F.col("is_numeric") & some, span),
            F.when(
                F.col("is_numeric") & some & (F.col("distinct_values") < P.FEW_DISTINCT),
                F.lit(DISTINCT_NUMBERS),
            ),
            F.when(F.col("is_text"), F.lit(f"{TEXT_TYPE}\n{TEXT_USE}")),
            F.when(
                F.col("is_text") & some & F.try_element_at(named, look).isNotNull(),
                F.concat(F.lit(FORMAT_LABEL), F.try_element_at(named, look)),
            ),
        ),
        _lines(
            F.format_string(UNIQUE_LINE, "distinct_values"),
            F.format_string(MISSING_LINE, "missing"),
            F.when(F.col("is_numeric") & (F.col("non_null") > P.TYPICAL_RANGE_MIN_ROWS), typical),
        ),
    )
    return profile.select(
        F.lit(6).alias("group"),
        "position",
        F.concat(F.lit("column_"), F.col("column")).alias("chunk_id"),
        F.lit("column").alias("type"),
        "column",
        content.alias("content"),
    )


GUIDANCE = (
    ("is_unique", "Columns that identify a record", "join two copies of the table on them, or tell its records apart by them"),
    ("is_grouping", "Columns with few values", "group by them, or pair records within the same value"),
    ("is_match", "Columns that records can share", "pair records that agree in them and differ in an identifying column"),
)
PAIRING = (
    "Records with the same value: join the table with itself on a shared column, where the identifying columns differ.",
    "Repeated values: group by a shared column and keep groups of more than one record.",
    "Pairs within a group: join on the grouping and the shared column, where one identifier is the smaller.",
)


def join_guidance(df: DataFrame, key: str, shown: int | None = None) -> DataFrame:
    """One chunk that says by which columns records of a table can be joined, grouped and matched.

    Lists name all columns of a class in the order of the table, or the first ``shown``; a class without columns has no line.
    ``key`` orders the rows, for the first value of text columns.
    """
    places = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, name string")
    traits = P.key_candidates(df, key).join(F.broadcast(places), F.col("column") == F.col("name"))
    # one row per column of the table
    lists = traits.agg(*(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("position", "column")))), lambda c: c["column"]).alias(flag)
        for flag, _, _ in GUIDANCE
    ))

    def line(flag: str, title: str, use: str) -> Column:
        names = F.col(flag) if shown is None else F.slice(flag, 1, shown)
        return F.when(F.size(flag) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, ", "), F.lit(f" ({use})")))

    text = F.concat_ws("\n", *(line(*g) for g in GUIDANCE), *(F.lit(p) for p in PAIRING))
    return lists.select(F.lit("join_guidance").alias("chunk_id"), F.lit("join_patterns").alias("type"), text.alias("content"))
