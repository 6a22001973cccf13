"""Searches asked by all documents, whatever their ids: none is left out of the questions."""

import pytest

import __spark_entry__ as entry

ROWS = [
    (7, "red apples and green pears", "en", "web", 26),
    (100, "green pears", "de", "wiki", 11),
    (101, "blue plums and red apples", "fr", "books", 25),
    (250, "yellow quinces of the garden", "es", "web", 28),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("all-documents"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    vectors = [(i, [1.0, float(i)], 0) for i, *_ in ROWS]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def found(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_contexts_of_all_documents(spark, folder):
    got = {r.query_id: r.context for r in found(spark, folder, "build_context_by_documents")}
    assert set(got) == {q for i, *_ in ROWS for q in (i, -1 - i)}
    assert all(got[i].startswith(f"Question: {text}\n") and text in got[i].split("\n", 1)[1] for i, text, *_ in ROWS)


def test_all_documents_are_searched_by_their_terms(spark, folder):
    got = found(spark, folder, "fused_search_by_documents")
    vectors = {-1 - i for i, *_ in ROWS}  # no text holds their word
    assert {r.query_id for r in got} == {i for i, *_ in ROWS} | vectors
    assert {(i, i) for i, *_ in ROWS} <= {(r.query_id, r.ordinal) for r in got}


def test_all_documents_are_searched_by_their_words(spark, folder):
    got = found(spark, folder, "lexical_search_by_documents")
    assert {r.query_id for r in got} == {i for i, *_ in ROWS}
    assert {(i, i, 1.0) for i, *_ in ROWS} <= {(r.query_id, r.ordinal, r.similarity) for r in got}
