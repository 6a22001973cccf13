"""Cleaning, files and plain filters."""

import datetime as dt

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridlore.operators import cleaning as C
from gridlore.operators import relational as R
from gridlore.operators.matching import clean_name
from gridlore.sources import files as N

NAMES = {
    "Part Key": "part_key",
    "'x'  (y)": "x_y",
    "1st": "col_1st",
    "__a__b__": "a_b",
    "größe €": "größe",
    "`q\"": "q",
    "!!": "",
}


@pytest.mark.parametrize("name", NAMES)
def test_clean_name(spark, name):
    assert C.clean_name(name) == NAMES[name]
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(clean_name(F.col("n"))).first()[0] == NAMES[name]


def test_equal_clean_names_stay_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a-b", "a_b"])
    clean, mapping = C.clean_names(df)
    assert clean.columns == ["a_b", "a_b_2", "a_b_3"]
    assert C.restore_names(clean.select("a_b_3", "a_b"), mapping).columns == ["a_b", "a b"]


def test_clean_table(spark):
    df = spark.createDataFrame(
        [(None, None, 1, None, None), ("x", None, None, True, dt.date(2024, 1, 1))],
        "t string, empty double, n int, b boolean, d date",
    )
    assert [r.asDict() for r in C.clean_table(df).collect()] == [
        {"t": "Unknown", "n": 1, "b": False, "d": None},
        {"t": "x", "n": 0, "b": True, "d": dt.date(2024, 1, 1)},
    ]


def test_display_cell(spark):
    df = spark.createDataFrame([("short",), ("exactly12chr",), ("thirteen char",)], "t string")
    got = [r[0] for r in df.select(C.display_cell(F.col("t"))).collect()]
    assert got == ["short          ", "exactly12chr   ", "thirteen ...   "]


def test_quoted_numbers(spark):
    df = spark.createDataFrame([(1, 123), (2, 5)], "i int, n int")
    assert [r.i for r in df.where(R.compare_quoted(df, "n", "=", "123")).collect()] == [1]
    assert [r.i for r in df.where(R.compare_quoted(df, "n", "<", "9")).collect()] == [2]
    assert df.where(R.compare_quoted(df, "n", "=", "123abc")).count() == 0
    assert df.where(R.compare_quoted(df, "n", "!=", "123abc")).count() == 2
    assert [r.i for r in df.where(R.in_quoted(df, "n", ["5", "x"])).collect()] == [2]


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "decimal(12,2)"])
def test_quoted_numbers_of_every_form(spark, kind):
    values = [-13, -12, -1, 0, 12, 13, 290000] + ([12.5, -12.5] if kind in ("double", "decimal(12,2)") else [])
    df = spark.createDataFrame([(float(v),) for v in values], "n double").select(F.col("n").cast(kind))
    literals = ["12.5", "-12.5", "-1", "+12", " 2.9e5 ", "13.", ".5", "1e99", "-1e99", "12.345"]
    for literal in literals:
        for sign, test in R.COMPARISONS.items():
            want = sorted(float(v) for v in values if test(Decimal(v), Decimal(literal.strip())))
            got = sorted(float(r.n) for r in df.where(R.compare_quoted(df, "n", sign, literal)).collect())
            assert got == want, (sign, literal)


def test_year_filter_reaches_the_scan(spark, tmp_path, capsys):
    df = spark.createDataFrame([(dt.datetime(y, 2, 3),) for y in (1996, 1997, 1998)], "t timestamp_ntz")
    df.write.parquet(str(tmp_path / "t"))
    kept = R.in_date_parts(spark.read.parquet(str(tmp_path / "t")), "t", year=1997, quarter=1)
    assert [r.t.year for r in kept.collect()] == [1997]
    kept.explain()
    assert "GreaterThanOrEqual(t" in capsys.readouterr().out


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'id,num,flag,word,mixed,empty\n'
        '1,1.5,True,NA,7,\n'
        '2,nan,False,"say ""hi"", you",x1,null\n'
        '3,-2e3,True,None?,,N/A\n'
        '4,1d,True,é,8,\n',
    )
    df = N.read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "num": "string", "flag": "boolean", "word": "string", "mixed": "string",
        "empty": "double",
    }
    rows = df.orderBy("id").collect()
    assert [r.word for r in rows] == [None, 'say "hi", you', "None?", "é"]
    assert [r.mixed for r in rows] == ["7", "x1", None, "8"]
    typed = N.read_csv(spark, str(path), "id int, num double, flag boolean, word string, mixed int, empty date")
    rows = typed.orderBy("id").collect()
    assert [r.num for r in rows] == [1.5, None, -2000.0, None]
    assert [r.mixed for r in rows] == [7, None, None, 8]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", cell', 2.5), (2, None, None), (3, "back\\slash", -0.125)]
    df = spark.createDataFrame(rows, "i bigint, t string, x double")
    N.write_csv(df, str(tmp_path / "out"))
    back = N.read_csv(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert back.dtypes == df.dtypes


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text(
        '[\n  {"question": "a?", "sources": [{"csv_name": "x.csv"}]},\n  {"question": "b?", "sources": []}\n]'
    )
    rows = N.read_json_array(spark, str(path)).orderBy("question").collect()
    assert [(r.question, [s.csv_name for s in r.sources]) for r in rows] == [("a?", ["x.csv"]), ("b?", [])]


def test_records_folder_layout(spark, tmp_path):
    df = spark.createDataFrame([("RAG", "a", 0.5), ("Baseline", "b", 0.25)], "mode string, csv_name string, s double")
    path = str(tmp_path / "records")
    N.write_records(df, path)
    assert (tmp_path / "records" / "mode=RAG" / "csv_name=a").is_dir()
    assert sorted(map(tuple, N.read_records(spark, path, df.schema).select(*df.columns).collect())) == sorted(
        map(tuple, df.collect())
    )


def test_partner_of_shared_values(spark):
    rows = [(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x")]
    df = spark.createDataFrame(rows, "k int, v string")
    got = {r.k: (r.partners, r.partner) for r in R.sharing_value(df, "v", "k").collect()}
    assert got == {1: (2, 6), 2: (2, 1), 6: (2, 1)}
    pairs = {r.v: r.pairs for r in R.pair_counts(df.where("v IS NOT NULL"), ["v"]).collect()}
    assert pairs == {"x": 3}


def test_leading_group_takes_first_name_on_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "g string, v double")
    assert R.leading_group(df, "g", "v").first().asDict() == {"groups": 3, "leader": "a", "leader_value": 2.0}
