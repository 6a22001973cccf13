"""Text functions against Python's re on texts of several scripts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlore.functions import answers as A
from gridlore.functions import sqltext as S
from gridlore.functions import text as X

PIECES = (
    "How many count of rows is 'x y' größe = 5 > 7 < 12 by straße per each status: F top 5 first 10 the "
    "average avg sum total highest lowest where with number of \"q r\" has have greater below été_2 ½ ２３ "
    "same date find duplicate pairs join a=b p=5q=6 c = 'D' is open was standby AND OR 1,250 3.5"
).split(" ")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    return ["", "  "] + [
        " ".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 14))) for _ in range(300)
    ]


@pytest.fixture(scope="module")
def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def call(expr):
        return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]

    return call


def T():
    return F.col("text")


def test_tokens(run, texts):
    assert run(X.tokens(T())) == [re.findall(r"\w+", t.lower()) for t in texts]


def test_keywords(run, texts):
    expected = [
        [w for w in re.findall(r"\b[a-z]{2,}\b", t.lower()) if w not in X.STOP_WORDS] for t in texts
    ]
    assert run(X.keywords(T())) == expected


def python_pattern(pattern):
    return pattern.replace(X.START, "").replace("++", "+").replace(X.WORD, r"\b\w+\b").replace(r"\p{Nd}", r"\d")


def test_mentions(run, texts):
    patterns = [python_pattern(p) for p, _ in X.MENTION_PATTERNS]
    expected = [sorted({m for p in patterns for m in re.findall(p, t)}) for t in texts]
    assert run(X.column_mentions(T())) == expected


def test_filters(run, texts):
    patterns = [(python_pattern(p), op) for p, op, _ in X.FILTER_PATTERNS]
    expected = [
        [(c.upper(), op, v) for p, op in patterns for c, v in re.findall(p, t)] for t in texts
    ]
    assert [[tuple(f) for f in r] for r in run(X.question_filters(T()))] == expected


def test_digit_condition_counts_twice(spark):
    df = spark.createDataFrame([("price = 10",)], "text string")
    got = [tuple(f) for f in df.select(X.question_filters(T())).first()[0]]
    assert got == [("PRICE", "=", "10"), ("PRICE", "=", "10")]


def test_intent(run, texts):
    def intent(t):
        for kind, words in X.AGGREGATION_WORDS.items():
            if any(re.search(rf"\b{w}\b", t.lower()) for w in words):
                return kind
        return "none"

    assert run(X.aggregation_intent(T())) == [intent(t) for t in texts]


def test_numbers(run, texts):
    assert run(X.numbers(T())) == [re.findall(r"\b\d+\b", t) for t in texts]


def test_search_terms_start_with_the_question(run, texts):
    for t, terms in zip(texts, run(X.search_terms(T()))):
        question = " ".join(t.split())
        assert len(terms) == len(set(terms))
        if question:
            assert terms[0] == question
            for w in re.findall(r"\w{3,}", question):
                if w.lower() not in X.SEARCH_SKIP_WORDS:
                    assert w in terms and w.upper() in terms


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("```sql\nSELECT a\nFROM t;\n```", "SELECT a FROM t"),
        ("sql: select a from t Note: this", "select a from t"),
        ("Answer: SELECT a FROM t -- all\n WHERE b = 10", "SELECT a FROM t WHERE b = 10"),
        ("SELECT 1 /* one\ntwo */ + 2\n\nThis query adds", "SELECT 1 + 2"),
        ("no statement; here", "no statement"),
        ("nothing", "nothing"),
        ("Here's what you want:\n```\nSELECT a FROM t\n```\nDone", "SELECT a FROM t Done"),
        ("It's easy: SELECT a /* no end", "SELECT a"),
        ("Use SELECT a FROM t -- not; here\nWHERE b = 1; ok", "SELECT a FROM t WHERE b = 1"),
    ],
)
def test_clean_sql(spark, text, expected):
    assert one(spark, S.clean_sql(T()), text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT a WHERE b = 1 FROM t", "SELECT a FROM t WHERE b = 1"),
        ("select a where b = 1", "select a FROM data WHERE b = 1"),
        ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1"),
        ("SELECT a FROM t", "SELECT a FROM t"),
        ("SELECT a WHERE b = 'FROM' FROM t GROUP BY a", "SELECT a FROM t WHERE b = 'FROM' GROUP BY a"),
    ],
)
def test_repair_sql(spark, text, expected):
    assert one(spark, S.repair_sql(T()), text) == expected


def test_sql_columns(spark):
    sql = (
        "SELECT a, SUM(b) AS s, 7, 'x' FROM t WHERE c >= 5 AND d LIKE 'e = 1' OR 9 = f "
        "GROUP BY a, 2 ORDER BY s DESC, a asc LIMIT 3"
    )
    df = spark.createDataFrame([(sql,)], "text string")
    got = S.with_sql_columns(df, T()).drop(*df.columns).first().asDict()
    assert got["selected"] == ["a", "b", "'__STR__'"]
    assert got["conditions"] == ["c", "d"]
    assert got["grouped"] == ["a"] and got["ordered"] == ["s", "a"]


def test_sql_operations(spark):
    df = spark.createDataFrame(
        [("SELECT accounts, limits FROM t",), ("select max(x) from a join b on 1=1 order  by 1 limit 2",)],
        "text string",
    )
    got = [r.asDict() for r in df.select(*[c.alias(k) for k, c in S.sql_operations(T()).items()]).collect()]
    assert not any(got[0].values())
    assert {k for k, v in got[1].items() if v} == {"order_by", "join", "limit", "aggregate"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select the [top] rows", "The top rows."),
        ("<|im_start|>done!", "Done!"),
        ("FROM where", ""),
        ("été group by fromage", "Été fromage."),
    ],
)
def test_clean_answer(spark, text, expected):
    assert one(spark, A.clean_answer(T()), text) == expected


@pytest.mark.parametrize("text, expected", [("a 1,250 b 7", 1250.0), ("about 12.", 12.0), ("none", None)])
def test_first_number(spark, text, expected):
    assert one(spark, A.first_number(T()), text) == expected
