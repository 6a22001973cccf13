"""Searches asked by documents: every document whose id is divisible by 100, whole, against all documents."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def asked(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return {r.doc_id for r in docs.where("doc_id % 100 = 0").select("doc_id").collect()}


@pytest.mark.parametrize("name", ["lexical_search", "hybrid_search", "fused_search", "build_context", "chunk_index_roundtrip"])
def test_documents_are_asked(spark, asked, name):
    got = {r.query_id for r in entry.queries()[f"{name}_by_documents"](spark, FOLDER).select("query_id").collect()}
    assert asked and {i for i in got if i >= 0} == asked
    assert name != "build_context" or {-1 - i for i in got if i < 0} == asked
