"""Properties that hold for whole results on the given tables."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from gridlore.operators import evaluation as V
from gridlore.operators import profile as P
from gridlore.operators import search as S
from gridlore.plans import scoring
from gridlore.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def result(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_lexical_scores_lie_between_bonus_and_one(spark):
    hits = result(spark, "lexical_search")
    low, high = hits.agg(F.min("similarity"), F.max("similarity")).first()
    assert 0.3 < low <= high <= 1.0
    worse = hits.alias("a").join(hits.alias("b"), "query_id").where(
        "a.rank < b.rank AND a.similarity < b.similarity"
    )
    assert worse.count() == 0


def test_every_vector_has_length_one(spark):
    lengths = result(spark, "vector_normalize").groupBy("vec_id").agg(F.sum(F.col("x") ** 2).alias("n"))
    assert lengths.where("abs(n - 1) > 1e-4").count() == 0
    assert lengths.count() == table(spark, FOLDER, "embeddings").count()


def test_outcomes_add_up(spark):
    s = result(spark, "eval_summary")
    assert s.where("wins + losses + ties <> questions").count() == 0
    shares = result(spark, "eval_win_rate").select((F.expr("wins_pct + losses_pct + ties_pct")).alias("p"))
    assert shares.where("abs(p - 100) > 1e-5").count() == 0


def test_each_question_has_one_record_per_mode(spark):
    records = scoring.records(spark, FOLDER)
    asked = scoring.asked(spark, FOLDER)
    assert records.count() == asked.count() == records.select("csv_file", "question_id", "mode").distinct().count()
    assert records.where("overall_score < 0.1 OR overall_score > 1").count() == 0


def test_duplicates_and_distinct_rows_add_up(spark):
    events = table(spark, FOLDER, "events").select("user_id", "event_type", F.floor("value").alias("v"))
    d = P.duplicates(events).first()
    assert d.rows == events.count() and d.duplicates == d.rows - events.distinct().count()


def test_histogram_counts_every_row(spark):
    assert result(spark, "histogram").agg(F.sum("n")).first()[0] == table(spark, FOLDER, "lineitem").count()


def test_shares_add_up_to_one(spark):
    for name in ("category_share", "format_profile"):
        sums = result(spark, name).groupBy("column").agg(F.sum("share").alias("s"))
        assert sums.where("abs(s - 1) > 1e-4").count() == 0


def test_pairs_agree_with_the_chain_of_next_records(spark):
    # a group of n records has n - 1 links in its chain and n (n - 1) / 2 pairs
    links = result(spark, "self_join_pairs").groupBy("user_id", "event_type").agg(F.count("*").alias("links"))
    pairs = result(spark, "pair_counts")
    both = pairs.join(links, ["user_id", "event_type"], "full")
    assert both.where("links IS NULL OR records IS NULL OR links <> records - 1").count() == 0


def test_kept_sources_are_enough_for_the_score(spark):
    sources = scoring.sources(spark, FOLDER)
    kept = V.response_sources(sources)
    assert V.source_quality(sources).exceptAll(V.source_quality(kept)).count() == 0


def test_search_does_not_depend_on_partitions(spark):
    asked = table(spark, FOLDER, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = table(spark, FOLDER, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("text").alias("content")
    )
    one = S.lexical_search(asked, chunks.coalesce(1), 5)
    many = S.lexical_search(asked, chunks.repartition(13), 5)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
