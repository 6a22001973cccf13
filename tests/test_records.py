"""Records of quoted CSV and of JSON arrays, cut in byte ranges of any size."""

import csv
import io
import json
import random

import pytest

from gridlore.sources import files as N
from gridlore.sources.records import CSV, JSON, split_records

NASTY = ["", "plain", 'say "hi"', "two\nlines", "a\r\nb", "{[", "]}", '}, {"a": 1}', "\\", '\\"', 'é "}" \\\\', ",", "x" * 700, "}\n{" * 9, '"', "'"]


@pytest.fixture(params=[300, 1 << 20])
def ranges(spark, request):
    """Byte ranges of so many bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(seed, n=60):
    rnd = random.Random(seed)
    return [(i, rnd.choice(NASTY), rnd.choice(NASTY) + rnd.choice(NASTY)) for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, ranges, indent):
    want = {}
    for f in range(3):
        rows = rows_of(f, [0, 1, 25][f])
        want |= {(f, i): (a, b) for i, a, b in rows}
        text = json.dumps([{"f": f, "i": i, "a": a, "n": {"b": [b, {"c": a}]}} for i, a, b in rows], indent=indent, ensure_ascii=bool(f % 2))
        (tmp_path / f"{f}.json").write_text(text)
    got = N.read_json_array(spark, str(tmp_path), "f int, i int, a string, n struct<b:array<string>>").collect()
    assert {(r.f, r.i): (r.a, r.n.b[0]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv(spark, tmp_path, ranges, end):
    want = []
    for f in range(2):
        rows = rows_of(f, 20)
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
        writer.writerow(["i", "a", "the b"])
        writer.writerows(rows)
        want += rows
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
    got = N.read_csv(spark, str(tmp_path), multi_line=True)
    assert got.columns == ["i", "a", "the b"] and dict(got.dtypes)["i"] == "bigint"
    null = lambda t: None if t in N.NA_TOKENS else t
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, null(a), null(b)) for i, a, b in want), key=str)
    typed = N.read_csv(spark, str(tmp_path), "`the b` string, i int", multi_line=True).collect()
    assert sorted(map(tuple, typed), key=str) == sorted(((null(b), i) for i, _, b in want), key=str)


def test_one_large_array_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write("[")
        f.write(",\n".join(json.dumps({"question": f"q{i} }}{{", "sources": [{"csv_name": "x" * 900}]}) for i in range(40_000)))
        f.write("]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = split_records(spark, str(path), JSON)
        assert found.count() == 40_000
        assert found.select("start").distinct().count() >= 8
        assert N.read_json_array(spark, str(path)).where("question LIKE 'q%'").count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split_records(spark, str(path), CSV).count() == 40_000
