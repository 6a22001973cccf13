"""Registered queries: files, stored indexes, chunk texts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions.answers import one_cell_text
from gridlore.functions.prompts import ADVICE, MATCHING_TEXT, NUMBERS_TEXT, SYSTEM_TEXT, render_prompt
from gridlore.functions.text import FIND_PARTS, GROUPING_PARTS, LIMIT_PATTERN, SAME_PARTS
from gridlore.operators import chunks as K
from gridlore.operators import search as S
from gridlore.plans.profiling import PARTS_SQL, parts_with_gaps
from gridlore.plans.questions import NUMBERS, ORDER_QUESTION, ORDER_SQL_TEXT, any_part, lit, says
from gridlore.plans.questions import QUESTIONS_SQL, questions
from gridlore.plans.registry import query
from gridlore.plans.retrieval import COLUMN_CASE, DOCUMENT_SQL, TYPE_CASE, asked_documents, chunks, lexical_sql
from gridlore.plans.scoring import DAYS_SQL, QA_SOURCES, QUESTION, RECORDS_SQL, days, records
from gridlore.session import scratch_path
from gridlore.sources import files as N
from gridlore.sources.tables import table

@query("scan_csv", f"""
WITH {PARTS_SQL} SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM parts
""")
def scan_csv(spark, sf):
    path = scratch_path(spark, "part-csv")
    N.write_csv(parts_with_gaps(spark, sf), path, missing="NA")
    return N.read_csv(spark, path)


@query("sink_csv", f"WITH {PARTS_SQL} SELECT * REPLACE (p_name || ', \"' || p_brand || '\"' AS p_name) FROM parts")
def sink_csv(spark, sf):
    """Cells with commas and quotes, written with their columns in another order and read back with a schema."""
    parts = parts_with_gaps(spark, sf).withColumn(
        "p_name", F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"'))
    )
    path = scratch_path(spark, "part-csv")
    N.write_csv(parts.select(*reversed(parts.columns)), path)
    return N.read_csv(spark, path, schema=parts.schema)


@query("scan_json", f"""
WITH {DAYS_SQL}, q AS (SELECT {QUESTION} AS question, {', '.join(f'{e} AS {c}' for c, e in QA_SOURCES.items())} FROM days)
SELECT question, array_to_string([s1, s2, s3], '|') AS sources, CAST(3 AS INTEGER) AS n FROM q
""")
def scan_json(spark, sf):
    pairs = days(spark, sf).select(
        F.expr(QUESTION).alias("question"),
        F.array(*[F.struct(F.expr(e).alias("csv_name")) for e in QA_SOURCES.values()]).alias("sources"),
    )
    path = scratch_path(spark, "qa-json")
    N.write_json_arrays(pairs, path)
    read = N.read_json_array(spark, path)
    return read.select(
        "question", F.array_join("sources.csv_name", "|").alias("sources"), F.size("sources").alias("n")
    )


@query("scan_jsonl", f"""
SELECT {ORDER_QUESTION} AS instruction, concat('orders: ', o_orderstatus) AS input, {ORDER_SQL_TEXT} AS output FROM orders
""")
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "corpus-jsonl")
    table(spark, sf, "orders").select(
        F.expr(ORDER_QUESTION).alias("instruction"),
        F.expr("concat('orders: ', o_orderstatus)").alias("input"),
        F.expr(ORDER_SQL_TEXT).alias("output"),
    ).write.json(path)
    return N.read_json_lines(spark, path)


@query("sink_json", f"""
WITH {RECORDS_SQL} SELECT question_id, question, overall_score, sql_valid, mode,
  regexp_extract(csv_file, '([^/]*)[.]csv$', 1) AS csv_name FROM records
""")
def sink_json(spark, sf):
    """Response records written to one folder per mode and table, and read back."""
    rows = records(spark, sf).select(
        "question_id", "question", "overall_score", "sql_valid", "mode",
        F.regexp_extract("csv_file", r"([^/]*)[.]csv$", 1).alias("csv_name"),
    )
    path = scratch_path(spark, "records-json")
    N.write_records(rows, path)
    return N.read_records(spark, path, rows.schema)


def index_sql(asked_sql):
    return f"""
WITH {asked_sql}, {lexical_sql('a', 3)}
SELECT query_id, rank, ordinal, round(similarity, 6) AS similarity, {TYPE_CASE} AS type, {COLUMN_CASE} AS "column",
       n_chars AS chars FROM lex JOIN documents ON ordinal = doc_id
"""


def _index_search(spark, sf, asked):
    """Store the chunk index, load it, and search in what was loaded."""
    path = scratch_path(spark, "chunk-index")
    N.save_index(chunks(spark, sf), path)
    index = N.load_index(spark, path)
    stored = index.chunks.withColumn("chars", F.length("content").cast("bigint"))
    hits = S.lexical_search(asked, stored, 3, ["type", "column", "chars"], index.postings)
    return hits.withColumn("similarity", F.round("similarity", 6)).select(
        "query_id", "rank", "ordinal", "similarity", "type", "column", "chars"
    )


@query("chunk_index_roundtrip", index_sql("a AS (SELECT item_id AS query_id, text FROM benchmark)"))
def chunk_index_roundtrip(spark, sf):
    return _index_search(spark, sf, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("chunk_index_roundtrip_by_documents", index_sql(DOCUMENT_SQL))
def chunk_index_roundtrip_by_documents(spark, sf):
    return _index_search(spark, sf, asked_documents(spark, sf).select(F.col("doc_id").alias("query_id"), "text"))


PART_KINDS = {
    "p_partkey": "int64", "p_name": "object", "p_brand": "object", "p_type": "object", "p_size": "int64",
    "p_retailprice": "float64",
}


def column_rows_sql():
    """One row per column of ``parts`` with the same fields as the column profile."""
    rows = []
    for i, (c, kind) in enumerate(PART_KINDS.items()):
        number = kind != "object"
        stats = ["avg", "stddev_samp", "min", "max"]
        fields = [f"{f}({c})::DOUBLE" if number else "NULL::DOUBLE" for f in stats]
        fields += [f"quantile_cont({c}::DOUBLE, {p})" if number else "NULL::DOUBLE" for p in (0.25, 0.75)]
        some = f"FROM parts WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY"
        top = f"SELECT {c}::VARCHAR AS v, count(*) AS n {some} n DESC, {c} LIMIT 10"
        first = f"SELECT {c}::VARCHAR AS v, min(p_partkey) AS o {some} o LIMIT 8"
        rows.append(f"""SELECT {i} AS p, '{c}' AS c, '{kind}' AS kind, {number} AS num,
  count(*) - count({c}) AS missing, count({c}) AS filled, count(DISTINCT {c}) AS nd, {fields[0]} AS mean,
  {fields[1]} AS std, {fields[2]} AS lo, {fields[3]} AS hi, {fields[4]} AS q25, {fields[5]} AS q75,
  (SELECT list({{'v': v, 'n': n}} ORDER BY n DESC, {'v::DOUBLE' if number else 'v'}) FROM ({top})) AS top,
  (SELECT list(v ORDER BY o) FROM ({first})) AS firsts FROM parts""")
    return "cols AS (" + "\nUNION ALL\n".join(rows) + ")"


NL = "chr(10)"
RULE_SQL = f"repeat('=', 50) || {NL} || {NL}"
HEAD_CELLS = " | ".join(f"{c:<15}" for c in PART_KINDS)
ROW_CELLS = " || ' | ' || ".join(
    f"rpad(CASE WHEN length({x}) > 12 THEN ({x})[1:9] || '...' ELSE {x} END, 15, ' ')"
    for x in (f"coalesce({c}::VARCHAR, 'nan')" for c in PART_KINDS)
)
PARTS_OF_FIRST = "string_split(firsts[1], '-')"
FORMAT_SQL = f"""CASE
  WHEN len({PARTS_OF_FIRST}) = 3 AND length({PARTS_OF_FIRST}[1]) = 2 AND length({PARTS_OF_FIRST}[3]) = 2
    THEN 'DD-XXX-YY (date-like)'
  WHEN len({PARTS_OF_FIRST}) = 3 AND length({PARTS_OF_FIRST}[1]) = 4 AND length({PARTS_OF_FIRST}[2]) = 2
    AND length({PARTS_OF_FIRST}[3]) = 2 THEN 'YYYY-MM-DD (date-like)'
  WHEN len({PARTS_OF_FIRST}) = 3 THEN NULL
  WHEN contains(firsts[1], '@') AND contains(firsts[1], '.') THEN 'Contains @ and . (email-like)'
  WHEN regexp_full_match(firsts[1], '[0-9]+') THEN 'Numeric string'
  WHEN len(regexp_extract_all(firsts[1], '\\S+')) = 1 THEN 'Single word' ELSE 'Multi-word text' END"""
TOP_THREE = "array_to_string(list_transform(top[1:3], lambda t: t.v), ', ')"


@query("profile_chunks", f"""
WITH {PARTS_SQL}, {column_rows_sql()},
out AS (
SELECT 0 AS g, 0 AS p, 'schema_0' AS chunk_id, 'schema' AS type, NULL::VARCHAR AS "column",
  '{K.SCHEMA_TITLE}' || {NL} || 'Dataset has ' || (SELECT count(*) FROM parts) || ' rows and 6 columns' || {NL}
  || '{K.SCHEMA_COLUMNS_TITLE}' || {NL}
  || string_agg('  - ' || c || ': ' || kind || ' (' || missing || ' missing values)' || {NL}, '' ORDER BY p)
  AS content FROM cols
UNION ALL
SELECT 1, 0, 'stats_numerical', 'statistics', NULL, '{K.NUMERIC_TITLE}' || {NL} || string_agg(
  {NL} || c || ':' || {NL} || printf('  Mean: %.2f', mean) || {NL} || printf('  Std: %.2f', std) || {NL}
  || printf('  Min: %.2f', lo) || {NL} || printf('  Max: %.2f', hi) || {NL}, '' ORDER BY p) FROM cols WHERE num
UNION ALL
SELECT 2, p, 'stats_' || c, 'statistics', c, '{K.TEXT_TITLE}' || c || {NL} || '{K.TOP_TITLE}' || {NL}
  || array_to_string(list_transform(top, lambda t: '  - ' || t.v || ': ' || t.n || {NL}), '')
  FROM cols WHERE NOT num
UNION ALL
SELECT 3, 0, 'schema_with_samples', 'schema_samples', NULL, '{K.SAMPLES_TITLE}' || {NL} || {RULE_SQL}
  || string_agg('Column: ' || c || {NL} || '  Type: ' || kind || {NL}
  || CASE WHEN NOT num OR nd < 20 THEN '  Sample values: ' || array_to_string(firsts, ', ')
     ELSE printf('  Range: %.2f to %.2f', lo, hi) || {NL} || '  Common values: ' || {TOP_THREE} END
  || {NL} || {NL}, '' ORDER BY p) FROM cols
UNION ALL
SELECT 4, 0, 'data_rows_table', 'data_rows', NULL, 'DATA ROWS (First ' || count(*) || ' rows):' || {NL}
  || {RULE_SQL} || '{HEAD_CELLS}' || {NL} || repeat('-', 96) || {NL}
  || string_agg({ROW_CELLS} || {NL}, '' ORDER BY p_partkey)
  FROM (SELECT * FROM parts ORDER BY p_partkey LIMIT 5)
UNION ALL
SELECT 5, 0, 'query_focused', 'query_insights', NULL, '{K.INSIGHTS_TITLE}' || {NL} || {RULE_SQL}
  || 'Numeric filter columns: ' || string_agg(c, ', ' ORDER BY p) FILTER (num) || {NL} || {NL}
  || string_agg('  ' || c || printf(': %.0f to %.0f (avg: %.0f)', lo, hi, mean) || {NL}, '' ORDER BY p) FILTER (num)
  || {NL} || 'Text filter columns: ' || string_agg(c, ', ' ORDER BY p) FILTER (NOT num) || {NL}
  || string_agg('  Common ''' || c || ''' values: ' || {TOP_THREE} || {NL}, '' ORDER BY p) FILTER (c = 'p_name')
  FROM cols
UNION ALL
SELECT 6, p, 'column_' || c, 'column', c, 'Column: ' || c || {NL}
  || CASE WHEN num THEN 'Type: Numeric' || {NL} || '{K.NUMERIC_USE}' || {NL}
       || printf('Range: Values from %.0f to %.0f', lo, hi) || {NL}
       || CASE WHEN nd < 20 THEN 'Contains: Distinct numeric values' || {NL} ELSE '' END
     ELSE 'Type: Text' || {NL} || '{K.TEXT_USE}' || {NL} || coalesce('Format: ' || {FORMAT_SQL} || {NL}, '') END
  || {NL} || 'Unique values: ' || nd || {NL} || 'Missing values: ' || missing || {NL}
  || CASE WHEN num AND filled > 10 THEN printf('Typical range (25-75%%): %.0f to %.0f', q25, q75) || {NL} ELSE '' END
  FROM cols)
SELECT chunk_id, row_number() OVER (ORDER BY g, p) - 1 AS ordinal, type, "column", content FROM out
""")
def profile_chunks(spark, sf):
    return K.profile_chunks(parts_with_gaps(spark, sf), "p_partkey")


@query("profile_columns", "WITH " + PARTS_SQL + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{d}' AS dtype, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values,
  {f"round(avg({c}), 6)" if n else "NULL::DOUBLE"} AS mean, {f"CAST(max({c}) AS DOUBLE)" if n else "NULL::DOUBLE"} AS max,
  (SELECT string_agg(v, ', ' ORDER BY o) FROM (SELECT {f"CAST({c} AS VARCHAR)" if n else c} AS v, min(p_partkey) AS o
     FROM parts WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY o LIMIT 8)) AS samples FROM parts"""
    for c, d, n in [("p_partkey", "int64", True), ("p_name", "object", False), ("p_brand", "object", False),
                    ("p_type", "object", False), ("p_size", "int64", True), ("p_retailprice", "float64", True)]))
def profile_columns(spark, sf):
    """The structured profile that the chunk texts are made of."""
    p = K.column_profile(parts_with_gaps(spark, sf), "p_partkey")
    return p.select(
        "column", "dtype", "missing", "distinct_values", F.round("mean", 6).alias("mean"), "max",
        F.array_join(F.transform("first", lambda f: f["value"]), ", ").alias("samples"),
    )


CONTEXT = "orders: o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("render_prompts", f"""
WITH {QUESTIONS_SQL}, q AS (SELECT id, text, lower(text) AS t, {NUMBERS % 'text'} AS ns FROM questions)
SELECT id, concat_ws(chr(10), {lit(SYSTEM_TEXT)}, 'Table:', {lit(CONTEXT)}, 'Question:', text,
  CASE WHEN regexp_matches(t, {lit(LIMIT_PATTERN)}) THEN {lit(ADVICE['limit'])}
       WHEN {says('t', 'highest', 'lowest', 'max', 'min')} THEN {lit(ADVICE['order by'])}
       WHEN {any_part('t', GROUPING_PARTS)} THEN {lit(ADVICE['group by'])} END,
  CASE WHEN len(ns) > 0 THEN {lit(NUMBERS_TEXT)} || array_to_string(ns, ', ') END,
  CASE WHEN (contains(t, 'same') AND {any_part('t', SAME_PARTS)}) OR (contains(t, 'find') AND {any_part('t', FIND_PARTS)})
       THEN {lit(MATCHING_TEXT)} END, 'SQL:') AS prompt FROM q
""")
def render_prompts(spark, sf):
    schema = table(spark, sf, "orders").dtypes
    context = F.lit("orders: " + ", ".join(f"{name} {kind}" for name, kind in schema))
    return questions(spark, sf).select("id", render_prompt(F.col("text"), context).alias("prompt"))


ONE_CELL_SQL = """CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'SELECT COUNT(*) FROM t' WHEN 1 THEN 'select sum(x) from t'
 WHEN 2 THEN 'SELECT AVG(x) FROM t' WHEN 3 THEN 'SELECT MAX(x), 1 FROM t' ELSE 'SELECT x FROM t' END"""


@query("one_cell_text", f"""
WITH r AS (SELECT o_orderkey, {ONE_CELL_SQL} AS s, o_totalprice * 3 AS v FROM orders)
SELECT o_orderkey, CASE WHEN contains(s, 'COUNT') THEN 'Found **' || CAST(floor(v) AS BIGINT) || '** matching records.'
  WHEN contains(s, 'sum(') THEN 'Total **x**: **' || format('{{:,.2f}}', v) || '**'
  WHEN contains(s, 'AVG(') THEN 'Average **x**: **' || format('{{:,.2f}}', v) || '**'
  WHEN contains(s, 'MAX(') THEN 'Maximum **x**: **' || format('{{:,.2f}}', v) || '**' END AS sentence FROM r
""")
def one_cell(spark, sf):
    results = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(ONE_CELL_SQL).alias("s"), (F.col("o_totalprice") * 3).alias("v")
    )
    sentence = one_cell_text(F.col("s"), F.lit("x"), F.col("v"))
    return results.select("o_orderkey", sentence.alias("sentence"))
