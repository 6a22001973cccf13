"""Every registered query against its SQL, and the shape of its plan."""

import contextlib
import io

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORPUS = {**entry.CORPUS_QUERIES, **entry.PIPELINE_QUERIES}  # tested in a folder of their own
QUERIES = {k: v for k, v in entry.queries().items() if k not in CORPUS}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in CORPUS}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    assert "CartesianProduct" not in plan.getvalue()
    assert "BroadcastNestedLoopJoin" not in plan.getvalue()
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.sales for r in rows] == sorted((r.sales for r in rows), reverse=True)
