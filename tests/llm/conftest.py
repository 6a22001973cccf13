import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    """(doc_id, text) of all test documents."""
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    data = [
        (1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "one two  three\tfour five six", "a"),
        (3, None, "a"), (4, "", None), (5, "   ", None), (6, long, "b"), (7, long + " end", "b"), (None, "one two three four five six", "c"),
        (8, "x", "c"), (9, "x\ny\nz\nx\ny\nz\nq", "c"), (10, "<|endoftext|>\u00e9\u0130 \u03a3\u03a3 \u00b2\u2167 don'T", "c"),
    ]
    return spark.createDataFrame(
        [(i, t, s, "en", 1, "k", 0, 5) for i, t, s in data],
        "doc_id long, text string, source string, lang string, n_chars long, keep_id string, size int, _id int",
    )


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
