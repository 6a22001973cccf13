"""Profiles and quantiles against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlore.operators import profile as P
from gridlore.operators.quantiles import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns():
    rnd = np.random.default_rng(3)
    n = 4000
    return {
        "plain": rnd.normal(size=n),
        "hot": np.where(rnd.random(n) < 0.4, 7.0, rnd.integers(0, 50, n)),
        "outliers": np.concatenate([rnd.random(n - 3), [1e300, -1e300, 1e18]]),
        "narrow": 1.7e9 + rnd.random(n),
        "tiny": rnd.random(n) * 1e-9 - 5e-10,
        "constant": np.full(n, 3.25),
        "gaps": np.where(rnd.random(n) < 0.5, np.nan, rnd.random(n)),
    }


@pytest.fixture(scope="module")
def frame(spark):
    data = columns()
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))


def test_quantiles(frame):
    got = {
        (r.column, r.prob): r.value
        for r in quantiles(frame, frame.columns, PROBS).collect()
    }
    for c, values in columns().items():
        values = values[~np.isnan(values)]
        for p in PROBS:
            assert got[c, p] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-18), (c, p)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles(empty, ["x"], [0.5]).count() == 0


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert P.numeric_stats(df).first().asDict() == {
        "column": "x", "count": 2, "mean": 2.0, "std": pytest.approx(2**0.5), "min": 1.0, "max": 3.0,
    }
    assert P.missing(df).first().missing == 2


def test_correlation_of_constant_and_missing(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 7.0, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    r = {(x.x, x.y): x.r for x in P.correlations(df).collect()}
    assert r["a", "b"] == pytest.approx(pd.Series([1, 2, 3]).corr(pd.Series([2, 4, 7])))
    assert r["a", "c"] is None and r["c", "d"] is None and r["a", "d"] is None


def test_value_counts_add_up(frame):
    counts = P.value_counts(frame.select(F.col("hot").cast("int").alias("hot"), "gaps"))
    totals = {r.column: (r.distinct_values, r.non_null) for r in P.distinct_counts(counts).collect()}
    data = columns()
    assert totals["hot"] == (len(set(data["hot"])), len(data["hot"]))
    present = data["gaps"][~np.isnan(data["gaps"])]
    assert totals["gaps"] == (len(set(present)), len(present))


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (9, "b"), (10, "a"), (100, "c")], "n int, t string")
    top = P.top_values(P.value_counts(df), 2)
    got = sorted((r.column, r["rank"], r.value, r.n) for r in top.collect())
    assert got == [("n", 1, "9", 2), ("n", 2, "10", 2), ("t", 1, "a", 2), ("t", 2, "b", 2)]


def test_minus_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert P.value_counts(df).collect()[0].n == 2


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (2, 1), (2, 1), (3, None)], "a int, b int")
    row = P.duplicates(df).first()
    assert (row.rows, row.duplicates) == (6, 3) and row.duplicate_pct == pytest.approx(50)


def test_key_candidates(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-{i:02d}", "ab"[i % 2], i % 30) for i in range(1, 40)],
        "row_id int, stamp string, kind string, other int",
    ).withColumn("birth_date", F.lit(1))
    got = {r.column: (r.id_like, r.is_unique, r.is_grouping, r.is_match) for r in
           P.key_candidates(df, "row_id").collect()}
    assert got == {
        "row_id": (True, True, False, False),
        "stamp": (False, True, False, True),
        "kind": (False, False, True, False),
        "other": (False, False, False, False),
        "birth_date": (False, False, True, True),
    }


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert [(r.bin, r.n) for r in P.histogram(df, "x").collect()] == [(0, 3)]


@pytest.mark.parametrize("kept", [3, 20, 1024])
def test_heavy_values_are_the_top_values(spark, monkeypatch, kept):
    """Common, evenly spread and unique values, ties at the end of the list, few values and none; for sketches of any size."""
    monkeypatch.setattr(P, "KEPT_VALUES", kept)
    rnd = np.random.default_rng(8)
    n = 3000
    rows = [
        (str(int(x)), int(y), str(i), float(i % 4), None if i % 3 else "z", None, bool(i % 2))
        for i, (x, y) in enumerate(zip(rnd.geometric(0.3, n), rnd.integers(0, 300, n)))
    ]
    df = spark.createDataFrame(rows, "hot string, even long, key string, few double, gaps string, none string, flag boolean").repartition(5)
    for most in (2, 10):
        got = sorted(map(tuple, P.heavy_values(df, n=most).select("column", "value", "n", "rank").collect()))
        want = P.top_values(P.value_counts(df), most).select("column", "value", "n", "rank").collect()
        assert got == sorted(map(tuple, want))
