"""Truth tables of the scores, the comparison, and name matching."""

import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators import evaluation as V
from gridlore.operators import matching as M

RESPONSE = (
    "csv_file string, question_id long, question string, mode string, sql_query string, answer string, "
    "sql_valid boolean, execution_success boolean, row_count long"
)


def scores(spark, responses, sources=()):
    r = spark.createDataFrame(
        [("f.csv", i, f"q{i}", *x) for i, x in enumerate(responses)], RESPONSE
    )
    s = spark.createDataFrame(
        [("f.csv", *x) for x in sources], "csv_file string, question_id long, mode string, similarity double"
    )
    return {x.question_id: x for x in V.score_responses(r, s).collect()}


def test_factuality_and_completeness(spark):
    cases = [
        # answer, valid, success, rows, factuality, completeness
        ("12 rows", False, True, 5, 0.2, 0.6),
        ("12 rows", True, False, 5, 0.3, 0.3),
        ("12 rows", True, True, 0, 0.7, 0.4),
        ("no digits", True, True, 5, 0.6, 0.6),
        ("12 rows", True, True, 5, 0.9, 0.6),
        ("0 rows", True, True, 5, 0.9, 0.6),
        ("It Shows 1,5", True, True, 5, 0.9, 0.9),
    ]
    got = scores(spark, [("RAG", "SELECT 1", a, v, s, n) for a, v, s, n, _, _ in cases])
    for i, (*_, fact, complete) in enumerate(cases):
        assert got[i].factuality_score == pytest.approx(fact), cases[i]
        assert got[i].completeness_score == pytest.approx(complete), cases[i]


def test_faithfulness(spark):
    cases = {
        0: ("Baseline", [0.9, 0.9], 0.3),
        1: ("RAG", [], 0.2),
        2: ("RAG", [0.71, 0.9], 1.0),
        3: ("RAG", [0.7, 0.9, 0.1], 0.8),
        4: ("RAG", [0.6, 0.51], 0.6),
        5: ("RAG", [0.6, 0.5], 0.4),
        6: ("RAG", [0.0], 0.4),
        7: ("RAG", [0.9] * 9, 1.0),
    }
    sources = [(i, mode, s) for i, (mode, sims, _) in cases.items() for s in sims]
    got = scores(spark, [(mode, "x", "y", True, True, 1) for mode, _, _ in cases.values()], sources)
    for i, (_, sims, score) in cases.items():
        assert got[i].faithfulness_score == score
        assert got[i].retrieved_sources_count == min(5, len(sims))


def test_safety_and_overall(spark):
    got = scores(
        spark,
        [
            ("RAG", "SELECT last_updated FROM t", "fine", True, True, 1),
            ("RAG", "SELECT 1", "the Password", True, True, 1),
            ("RAG", "SELECT 1", "fine 3", True, True, 1),
        ],
    )
    assert [got[i].safety_score for i in range(3)] == [0.0, 0.0, 1.0]
    assert got[2].overall_score == pytest.approx(0.3 * 0.9 + 0.25 * 0.6 + 0.25 * 0.2 + 0.2)


def test_incomplete_responses(spark):
    got = scores(spark, [("RAG", None, None, None, None, None), ("RAG", "SELECT 1", None, True, True, None)])
    assert (got[0].factuality_score, got[0].completeness_score, got[0].safety_score) == (0.2, 0.3, 1.0)
    assert got[0].sql_valid is False and got[1].factuality_score == pytest.approx(0.7)


def test_failed_and_comparison(spark):
    asked = spark.createDataFrame(
        [("f", 1, "a", "RAG"), ("f", 1, "a", "Baseline"), ("f", 2, "b", "RAG"), ("f", 2, "b?", "Baseline"),
         ("f", 3, "c", "RAG")],
        "csv_file string, question_id long, question string, mode string",
    )
    responses = spark.createDataFrame(
        [("f", 1, "a", "RAG", "SELECT 1", "about 5", True, True, 2)], RESPONSE
    )
    none = spark.createDataFrame([], "csv_file string, question_id long, mode string, similarity double")
    records = V.with_failed(asked, V.score_responses(responses, none))
    got = {(r.question_id, r.mode): r for r in records.collect()}
    assert got[1, "Baseline"].overall_score == 0.1 and got[1, "Baseline"].faithfulness_score == 0.1
    assert got[2, "RAG"].faithfulness_score == 0.2 and got[2, "RAG"].sql_valid is False
    # question 2 was asked in other words, question 3 in one mode only
    pair = V.compare_modes(records).collect()
    assert [p.question_id for p in pair] == [1]
    assert len(pair[0]) == 19  # 17 compared fields, the file and the number of the question
    assert pair[0].improvement == pytest.approx(pair[0].rag_overall_score - 0.1)
    s = V.summarise(V.compare_modes(records)).first()
    assert (s.questions, s.wins, s.losses, s.ties) == (1, 1, 0, 0) and s.wins_pct == 100


def test_relevant_questions(spark):
    qa = spark.createDataFrame(
        [(1, [("sales.csv",)]), (2, [("sales",), ("other",)]), (3, [("old_sales_2",)]), (4, [("sale",)]),
         (5, []), (6, [("Sales.csv",)])],
        "question_id long, sources array<struct<csv_name:string>>",
    )
    files = spark.createDataFrame([("/data/sales.csv",), ("C:\\data\\other.csv",)], "csv_file string")
    got = {(r.question_id, r.csv_file) for r in V.relevant_questions(qa, files).collect()}
    assert got == {
        (1, "/data/sales.csv"), (2, "/data/sales.csv"), (2, "C:\\data\\other.csv"), (3, "/data/sales.csv"),
    }


KNOWN = ["customer_id", "CustomerName", "unit price", "order_date", "qty", "sex", "order_days"]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(list(enumerate(KNOWN)), "position int, name string")


def test_match_stages(spark, known):
    cases = {
        "Unit Price": ("unit price", "exact"),
        "customername": ("CustomerName", "exact"),
        "price": ("unit price", "part"),
        "customerid": ("customer_id", "without underscores"),
        "cusomer_idd": ("customer_id", "similar"),
        "gender": ("sex", "synonym"),
        "xyzzy": (None, None),
    }
    requested = spark.createDataFrame([(c,) for c in cases for _ in range(3)], "asked string")
    got = {r.asked: (r.name, r.stage) for r in M.match_names(requested, known).collect()}
    assert got == cases


def test_no_known_names(spark, known):
    requested = spark.createDataFrame([("qty",)], "asked string")
    none = known.where("position < 0")
    assert M.match_names(requested, none).collect() == [("qty", None, None)]
    assert M.unknown_names(requested, none).collect() == [("qty", 1, None)]


def test_positions_may_have_gaps(spark):
    names = spark.createDataFrame([(70_000, "qty"), (5, "price")], "position int, name string")
    requested = spark.createDataFrame([("qty",)], "asked string")
    assert M.match_names(requested, names).first().name == "qty"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_and_containing_pairs_are_complete(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abc_") for _ in range(rnd.randrange(0, 9))) for _ in range(260)}
    asked, known = sorted(words)[::2], sorted(words)[1::2]
    a = spark.createDataFrame([(w,) for w in asked], "a string")
    c = spark.createDataFrame([(w,) for w in known], "c string")
    got = {(r.a, r.c) for r in M._similar(a, c).collect()}
    assert got == {(x, y) for x in asked for y in known if x and y and 1 - edits(x, y) / max(len(x), len(y)) >= 0.6}
    pairs = {(r.out, r["in"]) for r in M._containing(c.toDF("out"), a.toDF("in")).collect()}
    assert pairs == {(y, x) for x in asked for y in known if x and x in y}


def test_stages_agree_with_all_pairs(spark):
    rnd = random.Random(6)
    parts = ["date", "time", "name", "label", "id", "code", "sex", "gender", "qty", "x_", "_", "pay", ""]
    known = [rnd.choice(parts) + rnd.choice(parts) + rnd.choice("abcde") for _ in range(40)] + ["''"]
    asked = sorted({rnd.choice(parts) + rnd.choice("abcxyz") + rnd.choice(parts) for _ in range(80)} | {"", "!"})
    names = spark.createDataFrame(list(enumerate(known)), "position int, name string")
    requested = spark.createDataFrame([(w,) for w in asked], "asked string")
    got = {r.asked: (r.name, r.stage) for r in M.match_names(requested, names).collect()}
    clean = dict(spark.createDataFrame([(w,) for w in {*known, *asked}], "w string").select("w", M.clean_name(F.col("w"))).collect())

    def stage(a, k, i):
        c = clean[k]
        ratio = 1 - edits(a, c) / max(len(a), len(c), 1)
        has = lambda t, words: any(w in t for w in words)
        synonym = [n for n, (w, others) in enumerate(M.SYNONYMS.items()) if w in a and has(c, others)]
        related = any(has(a, [w, *others]) and has(c, [w, *others]) for w, others in M.SYNONYMS.items())
        tests = [a == c, a == k.lower(), a in c or c in a, a.replace("_", "") == c.replace("_", ""), ratio >= 0.6, synonym, related]
        n = next((n for n, t in enumerate(tests, 1) if t), None)
        return n and (n, -ratio if n == 5 else synonym[0] if n == 6 else 0, i, k)

    for w in asked:
        best = min(filter(None, (stage(clean[w], k, i) for i, k in enumerate(known))), default=None)
        assert got[w] == ((best[3], M.STAGES[best[0] - 1]) if best else (None, None)), w


def test_equal_numbers_in_two_files_stay_apart(spark):
    asked = spark.createDataFrame(
        [(f, 1, "a", m) for f in ("f", "g") for m in ("RAG", "Baseline")], "csv_file string, question_id long, question string, mode string"
    )
    responses = spark.createDataFrame(
        [("f", 1, "a", "RAG", "DROP x", "about 5", True, True, 2), ("g", 1, "a", "RAG", "SELECT 1", "about 5", True, True, 2)], RESPONSE
    )
    sources = spark.createDataFrame([("g", 1, "RAG", 0.9)], "csv_file string, question_id long, mode string, similarity double")
    records = V.with_failed(asked, V.score_responses(responses, sources)).collect()
    got = {(r.csv_file, r.mode): (r.safety_score, r.retrieved_sources_count) for r in records}
    assert got == {("f", "RAG"): (0.0, 0), ("g", "RAG"): (1.0, 1), ("f", "Baseline"): (1.0, 0), ("g", "Baseline"): (1.0, 0)}
    # of two records of one mode, one stands whole
    twice = spark.createDataFrame([*records, records[0]])
    assert V.compare_modes(twice).count() == 2


def test_unknown_names(spark, known):
    requested = spark.createDataFrame([("qty",), ("Customer ID",), ("ordr_date",), ("ordr_date",), ("zz",)], "asked string")
    got = {(r.asked, r.requests, r.suggestion) for r in M.unknown_names(requested, known).collect()}
    assert got == {("ordr_date", 2, "order_date"), ("zz", 1, None)}
