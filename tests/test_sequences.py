"""Order-based operators on a table where one group holds most rows, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlore.operators import sequences as Q

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def several_ranges(spark):
    """Keep the small ranges of a small table apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(3000):
        user = 1 if rnd.random() < 0.6 else rnd.randrange(2, 40)
        # a third of all rows share one time
        minute = 500 if rnd.random() < 0.33 else rnd.randrange(0, 20000)
        out.append((i, user, START + dt.timedelta(minutes=minute)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz")


def test_hot_group_spans_ranges(table):
    parts = Q.in_ranges(table, ["user", "ts", "id"]).where("user = 1").groupBy("_part").count()
    assert parts.count() > 1


def test_with_next(table, rows):
    groups = defaultdict(list)
    for i, user, ts in rows:
        groups[user].append((ts, i))
    expected = {}
    for members in groups.values():
        members.sort()
        for a, b in zip(members, members[1:] + [None]):
            expected[a[1]] = b[1] if b else None
    got = Q.with_next(table, ["user"], ["ts", "id"], {"id": "next_id"}).collect()
    assert {r.id: r.next_id for r in got} == expected


def test_with_rank(table, rows):
    order = [F.col("ts").desc(), F.col("id").asc()]
    expected = {
        i: place
        for place, (i, _, _) in enumerate(sorted(rows, key=lambda r: (START - r[2], r[0])), 1)
    }
    got = Q.with_rank(table, order, "place").collect()
    assert {r.id: r.place for r in got} == expected


def test_rows_without_group_or_time_stay(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, None, at), (2, None, at), (3, 7, None), (4, 7, at)]
    df = spark.createDataFrame(data, "id long, user long, ts timestamp")
    got = {r.id: r.n for r in Q.trailing_count(df, "user", "ts", "1 DAY", "n").collect()}
    assert got == {1: 2, 2: 2, 3: None, 4: 1}
    following = {r.id: r.after for r in Q.with_next(df.where("ts IS NOT NULL"), ["user"], ["ts", "id"], {"id": "after"}).collect()}
    assert following == {1: 2, 2: None, 4: None}


def test_trailing_count(table, rows):
    times = defaultdict(list)
    for _, user, ts in rows:
        times[user].append(ts)
    day = dt.timedelta(days=1)
    expected = {i: sum(ts - day <= t <= ts for t in times[user]) for i, user, ts in rows}
    got = Q.trailing_count(table, "user", "ts", "1 DAY", "n").collect()
    assert {r.id: r.n for r in got} == expected
