"""Registered queries: scores of answers, comparison of modes, name matching.

Questions and responses are derived from ``events``: one question per user and day, answered in two modes,
whose facts come from that day's events; the events themselves are the retrieved sources of the RAG mode.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from gridlore.functions import answers as A
from gridlore.functions import sqltext as S
from gridlore.operators import evaluation as V
from gridlore.operators import matching as M
from gridlore.plans.registry import query
from gridlore.sources.tables import table

QUESTION = "concat('What did user ', user_id, ' do on day ', d, '?')"
ANSWER = """CASE CAST((n + k) % 6 AS INT)
 WHEN 0 THEN concat('The result shows about ', n, ' events')
 WHEN 1 THEN concat('Total is 0 or ', purchases)
 WHEN 2 THEN 'No number here'
 WHEN 3 THEN concat('The password was used ', n, ' times')
 WHEN 4 THEN concat('It came to 1,', 200 + n, ' in all')
 ELSE concat('Found ', n, ' rows') END"""
FIELDS = {
    "RAG": {
        "k": "0",
        "question": QUESTION,
        "sql_query": "CASE WHEN n > 6 THEN 'DROP TABLE t' ELSE 'SELECT * FROM t' END",
        "sql_valid": "errors < 3",
        "execution_success": "errors < 2",
        "row_count": "purchases",
    },
    "Baseline": {
        "k": "1",
        "question": f"CASE WHEN purchases > 3 THEN concat({QUESTION}, ' Say it again.') ELSE {QUESTION} END",
        "sql_query": "CASE WHEN purchases > 2 THEN 'SELECT last_updated FROM t' ELSE 'SELECT * FROM t' END",
        "sql_valid": "errors < 2",
        "execution_success": "errors = 0",
        "row_count": "CAST(floor(purchases / 2) AS BIGINT)",
    },
}
CSV_FILE = "concat('data/file_', user_id % 4, '.csv')"
# numbers start anew in every file
QUESTION_ID = "CAST(floor(user_id / 4) AS BIGINT) * 100 + d"
DAY_ID = "user_id * 100 + d"
SIMILARITY = "least(value / 100, 1.0)"

DAYS_SQL = """days AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS d, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases
  FROM events GROUP BY user_id, CAST(day(ts) AS INTEGER))"""


def mode_sql(mode):
    f = FIELDS[mode]
    return f"""SELECT {CSV_FILE} AS csv_file, {QUESTION_ID} AS question_id, {f['question']} AS question,
  '{mode}' AS mode, {f['sql_query']} AS sql_query, {ANSWER} AS answer, {f['sql_valid']} AS sql_valid,
  {f['execution_success']} AS execution_success, {f['row_count']} AS row_count, n, errors
  FROM (SELECT *, {f['k']} AS k FROM days)"""


def days(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.dayofmonth("ts").alias("d"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        )
    )


def asked(spark, sf):
    """Every question in both modes, with what its response will hold; one pass over the days."""
    parts = [
        F.struct(
            F.lit(mode).alias("mode"),
            *[F.expr(f[c]).alias(c) for c in
              ("k", "question", "sql_query", "sql_valid", "execution_success", "row_count")],
        )
        for mode, f in FIELDS.items()
    ]
    return (
        days(spark, sf)
        .withColumn("m", F.explode(F.array(*parts)))
        .select("user_id", "d", "n", "errors", "purchases", "m.*")
        .select(
            F.expr(CSV_FILE).alias("csv_file"),
            F.expr(QUESTION_ID).alias("question_id"),
            "question",
            "mode",
            "sql_query",
            F.expr(ANSWER).alias("answer"),
            "sql_valid",
            "execution_success",
            "row_count",
            "n",
            "errors",
        )
    )


def responses(spark, sf):
    """A day of nothing but errors got no response."""
    return asked(spark, sf).where("errors < n")


def sources(spark, sf):
    return table(spark, sf, "events").select(
        F.expr(CSV_FILE).alias("csv_file"),
        F.expr(QUESTION_ID.replace(" d", " dayofmonth(ts)")).alias("question_id"),
        F.lit("RAG").alias("mode"),
        F.col("event_id").alias("source_id"),
        F.expr(SIMILARITY).alias("similarity"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
    )


FIRST_NUMBER = "TRY_CAST(nullif(replace(regexp_extract(answer, '[0-9]+[,.]?[0-9]*'), ',', ''), '') AS DOUBLE)"
FACTUALITY = f"""round(CASE WHEN NOT sql_valid THEN 0.2 WHEN NOT execution_success THEN 0.3 WHEN row_count = 0 THEN 0.7
  WHEN {FIRST_NUMBER} IS NULL THEN 0.6
  WHEN {FIRST_NUMBER} > 0 OR contains(answer, '0') THEN 0.9 ELSE 0.8 END::DOUBLE, 6)"""
COMPLETENESS = f"""CASE WHEN NOT execution_success THEN 0.3 WHEN row_count = 0 THEN 0.4
  WHEN regexp_matches(lower(answer), '{'|'.join(A.INSIGHT_WORDS)}') THEN 0.9 ELSE 0.6 END::DOUBLE"""
FAITHFULNESS = """CASE WHEN mode = 'Baseline' THEN 0.3 WHEN coalesce(sources, 0) = 0 THEN 0.2 WHEN high >= 2 THEN 1.0
  WHEN high = 1 THEN 0.8 WHEN medium >= 2 THEN 0.6 ELSE 0.4 END::DOUBLE"""
SAFETY = f"""CASE WHEN regexp_matches(lower(sql_query), '{'|'.join(S.UNSAFE_SQL)}')
  OR regexp_matches(lower(answer), '{'|'.join(A.HARMFUL_WORDS)}') THEN 0.0 ELSE 1.0 END::DOUBLE"""

RECORDS_SQL = f"""{DAYS_SQL},
asked AS MATERIALIZED ({mode_sql('RAG')} UNION ALL {mode_sql('Baseline')}),
src AS MATERIALIZED (SELECT {CSV_FILE} AS csv_file, {QUESTION_ID.replace(" d", " CAST(day(ts) AS INTEGER)")} AS question_id, 'RAG' AS mode, event_id AS source_id,
  {SIMILARITY} AS similarity, concat_ws(' ', event_type, props) AS content FROM events),
sq AS MATERIALIZED (SELECT csv_file, question_id, mode, least(count(*), 5) AS sources, count(*) FILTER (similarity > 0.7) AS high,
  count(*) FILTER (similarity > 0.5) AS medium FROM src GROUP BY csv_file, question_id, mode),
parts AS MATERIALIZED (SELECT csv_file, question_id, question, mode, sql_valid, execution_success,
  coalesce(sources, 0) AS retrieved_sources_count, {FACTUALITY} AS factuality_score,
  {COMPLETENESS} AS completeness_score, {FAITHFULNESS} AS faithfulness_score, {SAFETY} AS safety_score
  FROM asked LEFT JOIN sq USING (csv_file, question_id, mode) WHERE errors < n),
scored AS MATERIALIZED (SELECT *, round(factuality_score * 0.3::DOUBLE + completeness_score * 0.25::DOUBLE
  + faithfulness_score * 0.25::DOUBLE + safety_score * 0.2::DOUBLE, 6) AS overall_score FROM parts),
records AS MATERIALIZED (SELECT a.csv_file, a.question_id, a.question, a.mode, coalesce(s.sql_valid, false) AS sql_valid,
  coalesce(s.execution_success, false) AS execution_success,
  coalesce(retrieved_sources_count, 0) AS retrieved_sources_count,
  coalesce(factuality_score, 0.1::DOUBLE) AS factuality_score, coalesce(completeness_score, 0.1::DOUBLE) AS completeness_score,
  coalesce(faithfulness_score, CASE WHEN a.mode = 'Baseline' THEN 0.1 ELSE 0.2 END::DOUBLE) AS faithfulness_score,
  coalesce(safety_score, 1.0::DOUBLE) AS safety_score, coalesce(overall_score, 0.1::DOUBLE) AS overall_score
  FROM asked a LEFT JOIN scored s USING (csv_file, question_id, mode)),
comparison AS (SELECT r.csv_file, r.question_id, r.question,
  r.overall_score AS rag_overall_score, b.overall_score AS baseline_overall_score,
  r.factuality_score AS rag_factuality, b.factuality_score AS baseline_factuality,
  r.completeness_score AS rag_completeness, b.completeness_score AS baseline_completeness,
  r.faithfulness_score AS rag_faithfulness, b.faithfulness_score AS baseline_faithfulness,
  r.safety_score AS rag_safety, b.safety_score AS baseline_safety,
  r.sql_valid AS rag_sql_valid, b.sql_valid AS baseline_sql_valid,
  r.execution_success AS rag_execution_success, b.execution_success AS baseline_execution_success,
  r.retrieved_sources_count AS rag_sources_count, round(r.overall_score - b.overall_score, 6) AS improvement
  FROM records r JOIN records b ON r.csv_file = b.csv_file AND r.question_id = b.question_id
    AND r.question = b.question WHERE r.mode = 'RAG' AND b.mode = 'Baseline')"""


def scored(spark, sf):
    return V.score_responses(responses(spark, sf), sources(spark, sf)).withColumn(
        "factuality_score", F.round("factuality_score", 6)
    )


def records(spark, sf):
    return V.with_failed(asked(spark, sf), scored(spark, sf))


def score_query(score):
    @query(f"score_{score}", f"WITH {RECORDS_SQL} SELECT csv_file, question_id, mode, {score}_score FROM scored")
    def run(spark, sf):
        return scored(spark, sf).select("csv_file", "question_id", "mode", f"{score}_score")

    return run


for _score in ("factuality", "completeness", "faithfulness", "safety", "overall"):
    score_query(_score)


@query("score_failed_default", f"WITH {RECORDS_SQL} SELECT * FROM records")
def score_failed_default(spark, sf):
    return records(spark, sf)


@query("compare_modes", f"WITH {RECORDS_SQL} SELECT * FROM comparison")
def compare_modes(spark, sf):
    return V.compare_modes(records(spark, sf))


SUMMARY_SQL = """SELECT csv_file, count(*) AS questions, round(avg(rag_overall_score), 6) AS rag_average,
  round(avg(baseline_overall_score), 6) AS baseline_average, round(avg(improvement), 6) AS average_improvement,
  count(*) FILTER (rag_overall_score > baseline_overall_score) AS wins,
  count(*) FILTER (rag_overall_score < baseline_overall_score) AS losses,
  count(*) FILTER (rag_overall_score = baseline_overall_score) AS ties FROM comparison GROUP BY csv_file"""


@query("eval_summary", f"WITH {RECORDS_SQL} {SUMMARY_SQL}")
def eval_summary(spark, sf):
    s = V.summarise(V.compare_modes(records(spark, sf)))
    averages = ["rag_average", "baseline_average", "average_improvement"]
    return s.select(
        "csv_file", "questions", *[F.round(c, 6).alias(c) for c in averages], "wins", "losses", "ties"
    )


@query("eval_win_rate", f"""WITH {RECORDS_SQL}, s AS ({SUMMARY_SQL})
SELECT csv_file, round(wins * 100.0 / questions, 6) AS wins_pct, round(losses * 100.0 / questions, 6) AS losses_pct,
       round(ties * 100.0 / questions, 6) AS ties_pct FROM s""")
def eval_win_rate(spark, sf):
    s = V.summarise(V.compare_modes(records(spark, sf)))
    return s.select("csv_file", *[F.round(c, 6).alias(c) for c in ("wins_pct", "losses_pct", "ties_pct")])


@query("response_sources", f"""WITH {RECORDS_SQL}
SELECT csv_file, question_id, mode, source_id, round(similarity, 6) AS similarity, content,
       CAST(row_number() OVER (PARTITION BY csv_file, question_id, mode ORDER BY similarity DESC, source_id) AS INTEGER) AS rank
FROM src QUALIFY rank <= 5
""")
def response_sources(spark, sf):
    return V.response_sources(sources(spark, sf)).withColumn("similarity", F.round("similarity", 6))


QA_SOURCES = {
    "s1": "concat('file_', user_id % 4, '.csv')",
    "s2": "concat('archive/file_', user_id % 7)",
    "s3": "CASE WHEN n > 3 THEN 'notes.txt' ELSE concat('my_file_', user_id % 3, '_copy') END",
}


@query("question_relevance", f"""
WITH {DAYS_SQL}, q AS (SELECT {DAY_ID} AS question_id, {', '.join(f'{e} AS {c}' for c, e in QA_SOURCES.items())} FROM days),
f AS (SELECT DISTINCT {CSV_FILE} AS csv_file, concat('file_', user_id % 4) AS stem FROM events),
u AS (SELECT question_id, unnest([s1, s2, s3]) AS name FROM q)
SELECT DISTINCT question_id, csv_file FROM u JOIN f ON contains(name, stem)
""")
def question_relevance(spark, sf):
    names = days(spark, sf).selectExpr(
        f"{DAY_ID} AS question_id", *[f"{e} AS {c}" for c, e in QA_SOURCES.items()]
    )
    qa = names.select(
        "question_id",
        F.array(*[F.struct(F.col(c).alias("csv_name")) for c in QA_SOURCES]).alias("sources"),
    )
    files = table(spark, sf, "events").select(F.expr(CSV_FILE).alias("csv_file")).distinct()
    return V.relevant_questions(qa, files)


# ---- names ---------------------------------------------------------------------------------------

REQUESTED = """CASE CAST(c_custkey % 8 AS INT)
 WHEN 0 THEN concat('NATION_', c_nationkey)
 WHEN 1 THEN concat('"Nation ', c_nationkey, '"')
 WHEN 2 THEN concat('nation', c_nationkey)
 WHEN 3 THEN concat('natoin_', c_nationkey)
 WHEN 4 THEN concat('the-country-', c_nationkey)
 WHEN 5 THEN concat(c_nationkey, ' nations')
 WHEN 6 THEN concat('qx', c_nationkey, 'zz')
 ELSE concat('NATI0N_', c_nationkey) END"""


def requested(spark, sf):
    return table(spark, sf, "customer").select(F.expr(REQUESTED).alias("asked"))


def nations(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("position"), F.col("n_name").alias("name")
    )


def clean_sql(c):
    word = f"regexp_replace(regexp_replace(regexp_replace({c}, '[\"''`]', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '_+', '_', 'g')"
    word = f"regexp_replace({word}, '^_|_$', '', 'g')"
    return f"lower(CASE WHEN regexp_matches({word}, '^[^\\p{{L}}]') THEN 'col_' || {word} ELSE {word} END)"


@lru_cache
def synonym_sql():
    first = " ".join(
        f"WHEN contains(a, '{k}') AND regexp_matches(c, '{'|'.join(w)}') THEN {i}"
        for i, (k, w) in enumerate(M.SYNONYMS.items())
    )
    related = " OR ".join(
        f"(regexp_matches(a, '{'|'.join([k, *w])}') AND regexp_matches(c, '{'|'.join([k, *w])}'))"
        for k, w in M.SYNONYMS.items()
    )
    return f"CASE {first} END", related


RATIO_SQL = "1 - levenshtein(a, c) / greatest(length(a), length(c), 1)"
STAGE_SQL = f"""CASE WHEN a = c THEN 1 WHEN a = lower(n_name) THEN 2 WHEN contains(c, a) OR contains(a, c) THEN 3
  WHEN replace(a, '_', '') = replace(c, '_', '') THEN 4 WHEN {RATIO_SQL} >= 0.6 THEN 5
  WHEN ({synonym_sql()[0]}) IS NOT NULL THEN 6 WHEN {synonym_sql()[1]} THEN 7 END"""
STAGE_NAMES = "[" + ", ".join(f"'{s}'" for s in M.STAGES) + "]"


@query("name_match", f"""
WITH r AS (SELECT DISTINCT {REQUESTED} AS asked FROM customer), q AS (SELECT asked, {clean_sql('asked')} AS a FROM r),
k AS (SELECT n_nationkey, n_name, {clean_sql('n_name')} AS c FROM nation),
p AS (SELECT asked, n_nationkey, n_name, {STAGE_SQL} AS stage, {RATIO_SQL} AS ratio, {synonym_sql()[0]} AS syn FROM q, k),
o AS (SELECT asked, n_name, stage, row_number() OVER (PARTITION BY asked ORDER BY stage,
        CASE stage WHEN 5 THEN -ratio WHEN 6 THEN syn ELSE 0 END, n_nationkey) AS r FROM p WHERE stage IS NOT NULL)
SELECT q.asked, o.n_name AS name, {STAGE_NAMES}[o.stage] AS stage FROM q LEFT JOIN o ON q.asked = o.asked AND o.r = 1
""")
def name_match(spark, sf):
    return M.match_names(requested(spark, sf), nations(spark, sf))


@query("unknown_names", f"""
WITH r AS (SELECT {REQUESTED} AS asked, count(*) AS requests FROM customer GROUP BY 1),
q AS (SELECT asked, requests, {clean_sql('asked')} AS a FROM r),
k AS (SELECT n_nationkey, n_name, {clean_sql('n_name')} AS c FROM nation),
u AS (SELECT * FROM q WHERE a NOT IN (SELECT c FROM k)),
s AS (SELECT asked, n_name, row_number() OVER (PARTITION BY asked ORDER BY {RATIO_SQL} DESC, n_nationkey) AS r
      FROM u, k WHERE {RATIO_SQL} >= 0.6)
SELECT u.asked, u.requests, s.n_name AS suggestion FROM u LEFT JOIN s ON u.asked = s.asked AND s.r = 1
""")
def unknown_names(spark, sf):
    return M.unknown_names(requested(spark, sf), nations(spark, sf))
