"""Chunk texts of small tables with unusual columns."""

import datetime as dt

from pyspark.sql import functions as F

from gridlore.functions.prompts import render_prompt
from gridlore.operators import chunks as K
from gridlore.operators import cleaning as C
from gridlore.operators import profile as P


def texts(df, key):
    return {r.chunk_id: r.content for r in K.profile_chunks(df, key).collect()}


def test_mixed_table(spark):
    rows = [
        (i, f"user{i}@mail.org", i % 2 == 0, dt.date(2024, 1, i), None if i == 3 else i + 0.125)
        for i in range(1, 13)
    ]
    df = spark.createDataFrame(rows, "`order id` int, `e.mail` string, ok boolean, `d` date, x double")
    got = texts(df, "order id")
    assert list(got) == [
        "schema_0", "stats_numerical", "stats_e.mail", "schema_with_samples", "data_rows_table",
        "query_focused", "column_order id", "column_e.mail", "column_ok", "column_d", "column_x",
    ]
    assert got["schema_0"].splitlines()[1:] == [
        "Dataset has 12 rows and 5 columns",
        "Columns and their data types:",
        "  - order id: int64 (0 missing values)",
        "  - e.mail: object (0 missing values)",
        "  - ok: bool (0 missing values)",
        "  - d: datetime64[ns] (0 missing values)",
        "  - x: float64 (1 missing values)",
    ]
    assert "Format: Contains @ and . (email-like)" in got["column_e.mail"]
    assert got["column_x"].splitlines() == [
        "Column: x", "Type: Numeric", K.NUMERIC_USE, "Range: Values from 1 to 12",
        "Contains: Distinct numeric values", "", "Unique values: 11", "Missing values: 1",
        "Typical range (25-75%): 5 to 10",
    ]
    assert "1               | user1@mai...    | False           | 2024-01-01      | 1.125          \n" in got["data_rows_table"]
    assert "ID/Key columns: order id" in got["query_focused"]
    assert "  order id samples: 1, 2, 3, 4, 5\n" in got["query_focused"]
    assert "Column: ok\n  Type: bool\n  Sample values: False, True\n" in got["schema_with_samples"]


def test_table_without_numbers(spark):
    got = texts(spark.createDataFrame([("b", "x y"), ("a", "x y")], "k string, t string"), "k")
    assert "stats_numerical" not in got
    assert got["query_focused"].endswith("Text filter columns: k, t\n  Common 'k' values: a, b\n")
    assert got["stats_t"].endswith("  - x y: 2\n")


def test_empty_table(spark):
    got = texts(spark.createDataFrame([], "k int, t string"), "k")
    assert got["schema_0"].splitlines()[1] == "Dataset has 0 rows and 2 columns"
    assert "  Mean: nan" in got["stats_numerical"]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", None)], "`a.b` int, `c.d` string, `e f` double")
    assert C.clean_table(df).collect()[0][1] == "Unknown"
    assert {r.column: r.missing for r in P.missing(df).collect()} == {"a.b": 0, "c.d": 1, "e f": 1}
    assert P.duplicates(df).first().duplicates == 0
    assert {r.column: r.distinct_values for r in P.distinct_counts(P.value_counts(df)).collect()} == {
        "a.b": 2, "c.d": 1, "e f": 1,
    }
    assert P.correlations(df).count() == 1 and P.describe(df).count() == 2


def test_half_even_formatting(spark):
    values = [0.125, 2.675, 0.375, -0.125, 1234.5, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(K.fixed(F.col("x"), 2)).collect()] == [f"{v:.2f}" for v in values]
    assert [r[0] for r in df.select(K.fixed(F.col("x"), 0)).collect()][:3] == [f"{v:.0f}" for v in values][:3]


def test_prompt(spark):
    df = spark.createDataFrame([("Top 5 of the same date with 12?",), ("hello",)], "q string")
    got = [r[0] for r in df.select(render_prompt(F.col("q"), F.lit("t: a int"), "System")).collect()]
    assert got[0].splitlines() == [
        "System", "Table:", "t: a int", "Question:", "Top 5 of the same date with 12?",
        "The question asks for a number of rows: use LIMIT.", "Numbers to keep as they are: 5, 12",
        "Records with equal values: use GROUP BY with HAVING COUNT(*) > 1, or a self-join.", "SQL:",
    ]
    assert got[1].splitlines() == ["System", "Table:", "t: a int", "Question:", "hello", "SQL:"]
