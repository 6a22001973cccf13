"""Properties of plans that decide whether a query holds at scale."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlore.operators import matching as M
from gridlore.operators import quantiles as N
from gridlore.operators import relational as R
from gridlore.operators import sequences as Q
from gridlore.plans.retrieval import chunks
from gridlore.session import materialise, scratch_path
from gridlore.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def query_plan(spark, name, mode="simple"):
    return plan(entry.queries()[name](spark, FOLDER), mode)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("filter_compare", ["GreaterThanOrEqual(l_quantity,45.0)", "LessThan(l_discount,0.03)"]),
        ("filter_eq_and_or", ["EqualTo(o_orderstatus,F)", "Or(EqualTo(o_orderpriority"]),
        ("filter_in_between_null", ["In(p_size", "GreaterThanOrEqual(p_retailprice,950.0)"]),
        ("filter_date_part", ["GreaterThanOrEqual(o_orderdate,1997-01-01"]),
        ("filter_above_average", ["GreaterThan(p_retailprice,ScalarSubquery"]),
        ("typed_literal_filter", ["EqualTo(o_custkey,17)"]),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    text = query_plan(spark, name, "formatted")
    for p in pushed:
        assert p in text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("agg_basic", "struct<l_quantity:double,l_extendedprice:double>"),
        ("pair_counts", "struct<user_id:bigint,event_type:string>"),
        ("chunk_counts", "struct<lang:string>"),
        ("dedupe_keep_first", "struct<doc_id:bigint,text:string,lang:string,source:string>"),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: {columns}" in query_plan(spark, name)


@pytest.mark.parametrize(
    "name", ["lexical_search", "vector_search", "profile_top_values", "first_distinct_values", "top_per_group",
             "agg_mode", "response_sources"]
)
def test_ranks_are_cut_before_the_shuffle(spark, name):
    text = query_plan(spark, name)
    limits = re.findall(r"WindowGroupLimit.*(Partial|Final)", text)
    assert "Partial" in limits and "Final" in limits


def test_signatures_of_chunks_go_before_the_join(spark):
    """What follows a found chunk is read without moving its text."""
    text = plan(chunks(spark, FOLDER).select("ordinal", "type", "column", "signature"))
    moved = text[text.index("Join") :]
    assert "sha2(" in moved and "sha2(" not in text[: text.index("Join")]


def test_sums_go_before_the_join(spark):
    text = query_plan(spark, "sales_by_category")
    assert text.index("Join") < text.index("partial_sum((cast(l_extendedprice")


def test_quantiles_shuffle_only_values_near_a_wanted_rank(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "in_ranges", lambda df, order: seen.append(df.count()) or Q.in_ranges(df, order))
    rows = spark.range(200_000).selectExpr("cast(id * 7919 % 200003 as double) AS x", "cast(id as double) AS y")
    got = {r.column: r.value for r in N.quantiles(rows, ["x", "y"], [0.5]).collect()}
    assert got["y"] == 99_999.5 and len(seen) == 1
    assert seen[0] < 0.02 * 2 * 200_000


def test_a_hot_group_is_split_when_joined_with_its_aggregate(spark):
    """90 of 100 rows share a value; the aggregate comes from a written table, so that Spark may split the join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "32k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).selectExpr("CASE WHEN id % 10 > 0 THEN -1 ELSE id % 97 END AS v", "id AS k", "sha2(cast(id as string), 256) AS t")
        shared = R.sharing_value(materialise(rows, "rows"), "v", "k")
        assert shared.where("partners = 53999").count() == 54_000
        shared.write.format("noop").mode("overwrite").save()
        seen = shared.where("k >= 0")
        seen.collect()
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_meet_under_a_shared_key(spark):
    words = spark.range(3).selectExpr("cast(id as string) AS w")
    text = plan(M._containing(words.toDF("out"), words.toDF("in")))
    assert "NestedLoop" not in text and re.search(r"Join \[gram", text)
    text = plan(M._similar(words.toDF("a"), words.toDF("c")))
    assert "NestedLoop" not in text and re.search(r"Join \[k", text)


def test_intermediate_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = scratch_path(spark, "x")
    assert path.startswith(shared) and spark.sparkContext.applicationId in path
    assert path != scratch_path(spark, "x")


def test_written_tables_cut_the_lineage(spark):
    part = materialise(table(spark, FOLDER, "part").groupBy("p_brand").count(), "x")
    assert "Exchange" not in plan(part) and "gridlore" in plan(part)
    ranged = Q.in_ranges(table(spark, FOLDER, "part"), ["p_name", "p_partkey"])
    assert "rangepartitioning" not in plan(ranged)
