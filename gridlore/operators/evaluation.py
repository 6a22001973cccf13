"""Scoring tables of answers and comparing two ways of answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.answers import first_number, has_insight, is_harmful
from gridlore.functions.sqltext import is_unsafe_sql

# ---- fixed values of the scores ------------------------------------------------------------------
WEIGHTS = {"factuality": 0.3, "completeness": 0.25, "faithfulness": 0.25, "safety": 0.2}

INVALID_SQL = 0.2
FAILED_RUN = 0.3
VALID_AND_RUN = 0.6
NO_ROWS_BONUS = 0.1
NUMBER_BONUS = 0.2
PLAUSIBLE_BONUS = 0.1

COMPLETE_FAILED = 0.3
COMPLETE_EMPTY = 0.4
COMPLETE_INSIGHT = 0.9
COMPLETE_PLAIN = 0.6

HIGH_SIMILARITY = 0.7
MEDIUM_SIMILARITY = 0.5
FAITHFUL_BASELINE = 0.3
FAITHFUL_NO_SOURCE = 0.2
FAITHFUL_TWO_HIGH = 1.0
FAITHFUL_ONE_HIGH = 0.8
FAITHFUL_TWO_MEDIUM = 0.6
FAITHFUL_ANY = 0.4

FAILED_SCORE = 0.1
FAILED_FAITHFULNESS = {"Baseline": 0.1, "RAG": 0.2}
FAILED_SAFETY = 1.0
FAILED_OVERALL = 0.1

KEPT_SOURCES = 5
SOURCE_MARK = "..."
# ---- end of fixed values -------------------------------------------------------------------------

SCORES = list(WEIGHTS)
KEYS = ["csv_file", "question_id", "question", "mode"]
# a number names a question within its file only
RESPONSE = ["csv_file", "question_id", "mode"]


def factuality() -> Column:
    number = first_number(F.col("answer"))
    plausible = (number > 0) | F.col("answer").contains("0")
    base = F.lit(VALID_AND_RUN)
    return (
        F.when(~F.col("sql_valid"), INVALID_SQL)
        .when(~F.col("execution_success"), FAILED_RUN)
        .when(F.col("row_count") == 0, base + NO_ROWS_BONUS)
        .when(number.isNull(), base)
        .when(plausible, base + NUMBER_BONUS + PLAUSIBLE_BONUS)
        .otherwise(base + NUMBER_BONUS)
    )


def completeness() -> Column:
    return (
        F.when(~F.col("execution_success"), COMPLETE_FAILED)
        .when(F.col("row_count") == 0, COMPLETE_EMPTY)
        .when(has_insight(F.col("answer")), COMPLETE_INSIGHT)
        .otherwise(COMPLETE_PLAIN)
    )


def faithfulness() -> Column:
    return (
        F.when(F.col("mode") == "Baseline", FAITHFUL_BASELINE)
        .when(F.col("sources") == 0, FAITHFUL_NO_SOURCE)
        .when(F.col("high") >= 2, FAITHFUL_TWO_HIGH)
        .when(F.col("high") == 1, FAITHFUL_ONE_HIGH)
        .when(F.col("medium") >= 2, FAITHFUL_TWO_MEDIUM)
        .otherwise(FAITHFUL_ANY)
    )


def safety() -> Column:
    return F.when(is_unsafe_sql(F.col("sql_query")) | is_harmful(F.col("answer")), 0.0).otherwise(1.0)


def overall() -> Column:
    return F.round(sum((F.col(f"{s}_score") * w for s, w in WEIGHTS.items()), F.lit(0.0)), 6)


def source_quality(sources: DataFrame) -> DataFrame:
    """Numbers of kept, good and fair sources per response.

    The kept sources are the most similar ones, so counts over all sources cut at the number kept equal
    counts over the kept ones, and need no ranking.
    """

    def kept(n: Column) -> Column:
        return F.least(n, F.lit(KEPT_SOURCES))

    return sources.groupBy(*RESPONSE).agg(
        kept(F.count("*")).alias("sources"),
        kept(F.count_if(F.col("similarity") > HIGH_SIMILARITY)).alias("high"),
        kept(F.count_if(F.col("similarity") > MEDIUM_SIMILARITY)).alias("medium"),
    )


def score_responses(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Scores per response.

    responses(csv_file, question_id, question, mode, sql_query, answer, sql_valid, execution_success,
    row_count), sources(csv_file, question_id, mode, similarity). What a response lacks counts as false, 0 or empty.
    """
    responses = responses.na.fill(False, ["sql_valid", "execution_success"])
    responses = responses.na.fill(0, ["row_count"]).na.fill("", ["sql_query", "answer"])
    joined = responses.join(source_quality(sources), RESPONSE, "left").na.fill(
        0, ["sources", "high", "medium"]
    )
    scored = joined.select(
        *KEYS,
        "sql_valid",
        "execution_success",
        F.col("sources").alias("retrieved_sources_count"),
        factuality().alias("factuality_score"),
        completeness().alias("completeness_score"),
        faithfulness().alias("faithfulness_score"),
        safety().alias("safety_score"),
    )
    return scored.withColumn("overall_score", overall())


def with_failed(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """Give every question asked in every mode a record; one without a response gets fixed scores.

    asked(csv_file, question_id, question, mode). The fixed overall score is not the weighted sum.
    """
    failed_faith = F.when(F.col("mode") == "Baseline", FAILED_FAITHFULNESS["Baseline"]).otherwise(
        FAILED_FAITHFULNESS["RAG"]
    )
    default = {
        "sql_valid": F.lit(False),
        "execution_success": F.lit(False),
        "retrieved_sources_count": F.lit(0),
        "factuality_score": F.lit(FAILED_SCORE),
        "completeness_score": F.lit(FAILED_SCORE),
        "faithfulness_score": failed_faith,
        "safety_score": F.lit(FAILED_SAFETY),
        "overall_score": F.lit(FAILED_OVERALL),
    }
    known = scored.select(*RESPONSE, *default)
    joined = asked.select(*KEYS).join(known, RESPONSE, "left")
    return joined.select(*KEYS, *[F.coalesce(c, d).alias(c) for c, d in default.items()])


def compare_modes(records: DataFrame, first: str = "RAG", second: str = "Baseline") -> DataFrame:
    """Both modes of a question side by side, where both asked the same words.

    Conditional aggregates set the records side by side with one shuffle and one pass instead of a join of two
    passes. Of several records of a question and mode one stands whole: that with the highest overall score, then
    the highest in the order of the fields.
    """
    kept = {
        "overall_score": "overall_score",
        **{f"{s}_score": s for s in SCORES},
        "sql_valid": "sql_valid",
        "execution_success": "execution_success",
    }

    record = F.struct(*kept, "retrieved_sources_count", "question")
    pairs = records.groupBy("csv_file", "question_id").agg(
        *[F.max(F.when(F.col("mode") == m, record)).alias(side) for m, side in ((first, "_1"), (second, "_2"))]
    )
    columns = [F.col("_1.question").alias("question")]
    for column, name in kept.items():
        columns += [
            F.col(f"{side}.{column}").alias(f"{m.lower()}_{name}") for m, side in ((first, "_1"), (second, "_2"))
        ]
    columns.append(F.col("_1.retrieved_sources_count").alias(f"{first.lower()}_sources_count"))
    pairs = pairs.where("_1.question = _2.question").select("csv_file", "question_id", *columns)
    gain = F.col(f"{first.lower()}_overall_score") - F.col(f"{second.lower()}_overall_score")
    return pairs.withColumn("improvement", F.round(gain, 6))


def summarise(comparison: DataFrame) -> DataFrame:
    """Averages, wins, losses and ties per file."""
    rag, base = F.col("rag_overall_score"), F.col("baseline_overall_score")
    counts = comparison.groupBy("csv_file").agg(
        F.count("*").alias("questions"),
        F.avg(rag).alias("rag_average"),
        F.avg(base).alias("baseline_average"),
        F.avg("improvement").alias("average_improvement"),
        F.count_if(rag > base).alias("wins"),
        F.count_if(rag < base).alias("losses"),
        F.count_if(rag == base).alias("ties"),
    )
    return counts.select(
        "*",
        *[(F.col(c) / F.col("questions") * 100).alias(f"{c}_pct") for c in ("wins", "losses", "ties")],
    )


def response_sources(sources: DataFrame, chars: int | None = None) -> DataFrame:
    """The most similar sources of each response, with their text or, if asked for, its start and a mark."""
    w = Window.partitionBy(*RESPONSE).orderBy(F.col("similarity").desc(), "source_id")
    kept = sources.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= KEPT_SOURCES)
    if chars is None:
        return kept
    return kept.withColumn("content", F.concat(F.substring("content", 1, chars), F.lit(SOURCE_MARK)))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.replace(name, F.lit(".csv"), F.lit(""))


def relevant_questions(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(question_id, csv_file) where a source of the question names the file.

    questions(question_id, sources array<struct<csv_name>>), files(csv_file). A source names a file when
    it contains the file's stem, which covers equal names with and without the ending. Substrings of each distinct
    source name, of those lengths only that stems have, are looked up among the stems by an equi-join.
    """
    stems = files.select("csv_file", file_stem(F.col("csv_file")).alias("stem")).where("stem <> ''")
    named = questions.select("question_id", F.explode("sources.csv_name").alias("name"))
    lengths = stems.agg(F.collect_set(F.length("stem"))).scalar()  # as many as there are lengths of names
    starts = F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)
    spans = F.transform(starts, lambda start: F.substring(F.col("name"), start, F.col("n")))
    names = named.select("name").where("name <> ''").distinct().select("name", F.explode(lengths).alias("n"))
    matches = (
        names.where("n <= length(name)").select("name", F.explode(F.array_distinct(spans)).alias("stem"))
        .join(stems, "stem")
        .select("name", "csv_file")
    )
    return named.join(matches, "name").select("question_id", "csv_file").distinct()
