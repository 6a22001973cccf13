"""Registered queries: cleaning, profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import chunks as H
from gridlore.operators import cleaning as C
from gridlore.operators import profile as P
from gridlore.plans.registry import query
from gridlore.sources.tables import table

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
PART_TEXT = ["p_name", "p_brand", "p_type"]


def lines_with_gaps(spark, sf):
    """lineitem with missing cells: the test tables have none of their own."""
    return (
        table(spark, sf, "lineitem")
        .withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
        .withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
        .withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    )


LINES_SQL = """lines AS (SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
                         nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem)"""


def parts_with_gaps(spark, sf):
    return table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))


PARTS_SQL = "parts AS (SELECT * REPLACE (nullif(p_type, 'PROMO') AS p_type) FROM part)"


def union_sql(columns, template):
    return "\nUNION ALL\n".join(template.format(c=c) for c in columns)


def long_sql(source, numbers, texts, ordinal="NULL"):
    """(column, text, number, o) over several columns of a table."""
    parts = [
        f"SELECT '{c}' AS \"column\", NULL AS text, CAST({c} AS DOUBLE) AS number, {ordinal} AS o FROM {source}"
        for c in numbers
    ] + [
        f"SELECT '{c}' AS \"column\", {c} AS text, NULL AS number, {ordinal} AS o FROM {source}"
        for c in texts
    ]
    return "cells AS (" + "\nUNION ALL ".join(parts) + ")"


# ---- cleaning ------------------------------------------------------------------------------------


@query("drop_empty_columns", "SELECT * FROM part")
def drop_empty_columns(spark, sf):
    parts = table(spark, sf, "part")
    with_empty = parts.withColumn("p_comment", F.lit(None).cast("string")).withColumn(
        "p_weight", F.lit(None).cast("double")
    )
    return C.drop_empty_columns(with_empty)


@query("fill_by_type", """
SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), 'Unknown') AS p_type,
       coalesce(nullif(p_size, 7), 0) AS p_size, coalesce(nullif(p_retailprice, 900), 0) AS p_retailprice,
       coalesce(CASE WHEN p_size > 10 THEN p_size > 20 END, false) AS is_large
FROM part
""")
def fill_by_type(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.nullif("p_type", F.lit("PROMO")).alias("p_type"),
        F.nullif("p_size", F.lit(7)).alias("p_size"),
        F.nullif("p_retailprice", F.lit(900.0)).alias("p_retailprice"),
        F.when(F.col("p_size") > 10, F.col("p_size") > 20).alias("is_large"),
    )
    return C.fill_by_type(parts)


@query("project_columns", """
SELECT p_partkey AS "Part Key", p_name AS "part-key", p_brand AS "1st brand!",
       p_retailprice * 2 AS "Retail  Price ($)" FROM part WHERE p_size > 25
""")
def project_columns(spark, sf):
    messy = table(spark, sf, "part").toDF(
        "Part Key", "part-key", "1st brand!", "'Type'", "p size", "Retail  Price ($)"
    )
    clean, mapping = C.clean_names(messy)
    chosen = clean.where("p_size > 25").select(
        "part_key", "part_key_2", "col_1st_brand", (F.col("retail_price") * 2).alias("retail_price")
    )
    return C.restore_names(chosen, mapping)


@query("display_cells", "SELECT " + ", ".join(
    f"rpad(CASE WHEN length(CAST({c} AS VARCHAR)) > 12 THEN CAST({c} AS VARCHAR)[1:9] || '...' "
    f"ELSE CAST({c} AS VARCHAR) END, 15, ' ') AS {c}"
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
) + " FROM customer")
def display_cells(spark, sf):
    customers = table(spark, sf, "customer")
    return customers.select(
        *[C.display_cell(F.col(c)).alias(c) for c in customers.columns]
    )


# ---- statistics ----------------------------------------------------------------------------------


@query("profile_numeric", f"WITH {LINES_SQL}\n" + union_sql(LINE_NUMBERS, """
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM lines"""))
def profile_numeric(spark, sf):
    d = P.describe(lines_with_gaps(spark, sf))
    return d.select(
        "column", "count", "min", "max",
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")],
    )


@query("profile_iqr", f"WITH {LINES_SQL}\n" + union_sql(LINE_NUMBERS, """
SELECT '{c}' AS "column", count({c}) AS count,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM lines HAVING count({c}) > 10"""))
def profile_iqr(spark, sf):
    r = P.typical_range(lines_with_gaps(spark, sf))
    return r.select("column", "count", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"))


@query("profile_ranges", union_sql(PART_NUMBERS, """
SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(avg({c}), 6) AS mean FROM part"""))
def profile_ranges(spark, sf):
    stats = P.numeric_stats(table(spark, sf, "part"))
    return stats.select("column", "min", "max", F.round("mean", 6).alias("mean"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("profile_distinct", union_sql(ORDER_COLUMNS, """
SELECT '{c}' AS "column", count(DISTINCT nullif(CAST({c} AS VARCHAR), 'P')) AS distinct_values,
       CAST(count(nullif(CAST({c} AS VARCHAR), 'P')) AS BIGINT) AS non_null FROM orders"""))
def profile_distinct(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return P.distinct_counts(P.value_counts(orders))


@query("profile_top_values", f"WITH {PARTS_SQL}, {long_sql('parts', PART_NUMBERS, PART_TEXT)}" + """
SELECT "column", text, number, n, rank FROM (
  SELECT "column", text, number, count(*) AS n,
         CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, number, text) AS INTEGER) AS rank
  FROM cells WHERE text IS NOT NULL OR number IS NOT NULL GROUP BY "column", text, number)
WHERE rank <= 10
""")
def profile_top_values(spark, sf):
    top = P.top_values(P.value_counts(parts_with_gaps(spark, sf)))
    return top.select("column", *P.split_value(top), "n", "rank")


HEAVY_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_extendedprice"]


@query("profile_heavy_values", f"WITH {LINES_SQL}, {long_sql('lines', HEAVY_NUMBERS, ['l_returnflag', 'l_linestatus'])}" + """
SELECT "column", text, number, n, rank FROM (
  SELECT "column", text, number, count(*) AS n,
         CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, number, text) AS INTEGER) AS rank
  FROM cells WHERE text IS NOT NULL OR number IS NOT NULL GROUP BY "column", text, number)
WHERE rank <= 10
""")
def profile_heavy_values(spark, sf):
    lines = lines_with_gaps(spark, sf)
    top = P.heavy_values(lines, [*HEAVY_NUMBERS, "l_returnflag", "l_linestatus"])
    return top.select("column", *P.split_value(top), "n", "rank")


@query("category_share", f"WITH {PARTS_SQL}, {long_sql('parts', [], PART_TEXT)}," + """
top AS (SELECT "column", text, count(*) AS n,
               row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, text) AS rank
        FROM cells WHERE text IS NOT NULL GROUP BY "column", text)
SELECT "column", text, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share FROM top WHERE rank <= 10
""")
def category_share(spark, sf):
    top = P.top_values(P.value_counts(parts_with_gaps(spark, sf), PART_TEXT))
    shares = P.category_share(top)
    return shares.select("column", F.col("value").alias("text"), "n", F.round("share", 6).alias("share"))


@query("first_distinct_values", f"WITH {PARTS_SQL}, {long_sql('parts', PART_NUMBERS, PART_TEXT, 'p_partkey')}" + """
SELECT "column", text, number, position FROM (
  SELECT "column", text, number,
         CAST(row_number() OVER (PARTITION BY "column" ORDER BY min(o)) AS INTEGER) AS position
  FROM cells WHERE text IS NOT NULL OR number IS NOT NULL GROUP BY "column", text, number)
WHERE position <= 8
""")
def first_distinct_values(spark, sf):
    counts = P.value_counts(parts_with_gaps(spark, sf), ordinal="p_partkey")
    firsts = P.first_values(counts)
    return firsts.select("column", *P.split_value(firsts), "position")


def pair_sql(a, b):
    return f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM lines"


@query("correlation_matrix", f"WITH {LINES_SQL}\n" + "\nUNION ALL\n".join(
    pair_sql(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]))
def correlation_matrix(spark, sf):
    r = P.correlations(lines_with_gaps(spark, sf))
    return r.withColumn("r", F.round("r", 6))


@query("table_shape", """
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns,
       CAST(2 AS BIGINT) AS text_columns, CAST(0 AS BIGINT) AS boolean_columns,
       CAST(1 AS BIGINT) AS datetime_columns FROM orders
""")
def table_shape(spark, sf):
    return P.table_shape(table(spark, sf, "orders"))


@query("histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem),
p AS (SELECT least(floor((l_extendedprice - (SELECT lo FROM b)) / (SELECT w FROM b)), 9) AS bin FROM lineitem)
SELECT CAST(bin AS BIGINT) AS bin, round((SELECT lo FROM b) + bin * (SELECT w FROM b), 6) AS bin_from,
       round((SELECT lo FROM b) + (bin + 1) * (SELECT w FROM b), 6) AS bin_to, count(*) AS n FROM p GROUP BY bin
""")
def histogram(spark, sf):
    h = P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10)
    return h.select(
        "bin", F.round("bin_from", 6).alias("bin_from"), F.round("bin_to", 6).alias("bin_to"), "n"
    )


BOX_COLUMNS = ["event_id", "user_id", "value"]


@query("box_stats", union_sql(BOX_COLUMNS, """
SELECT '{c}' AS "column", min(x) AS min, round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS q50,
       round(any_value(q3), 6) AS q75, max(x) AS max,
       round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_fence,
       round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_fence,
       min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
       max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
       count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM events),
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM events)"""))
def box_stats(spark, sf):
    b = P.box_stats(table(spark, sf, "events"))
    rounded = ["q25", "q50", "q75", "lower_fence", "upper_fence"]
    return b.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in b.columns])


# ---- quality -------------------------------------------------------------------------------------

QUALITY_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query("quality_missing", f"WITH {LINES_SQL}, m AS (" + union_sql(QUALITY_COLUMNS, """
SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
       round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM lines""") + """)
SELECT *, CAST(sum(missing) OVER () AS BIGINT) AS total_missing FROM m
""")
def quality_missing(spark, sf):
    m = P.missing(lines_with_gaps(spark, sf))
    return m.withColumn("missing_pct", F.round("missing_pct", 6))


@query("quality_duplicates", """
WITH e AS (SELECT user_id, nullif(event_type, 'error') AS event_type, floor(value) AS value FROM events),
d AS (SELECT DISTINCT * FROM e)
SELECT (SELECT count(*) FROM e) AS rows, (SELECT count(*) FROM e) - (SELECT count(*) FROM d) AS duplicates,
       round(((SELECT count(*) FROM e) - (SELECT count(*) FROM d)) * 100.0 / (SELECT count(*) FROM e), 6)
         AS duplicate_pct
""")
def quality_duplicates(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.floor("value").alias("value")
    )
    return P.duplicates(events).withColumn("duplicate_pct", F.round("duplicate_pct", 6))


KEY_CANDIDATES_SQL = union_sql(ORDER_COLUMNS, """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count({c}) AS non_null,
       regexp_matches('{c}', 'id|code|number|no') AS id_like, count(DISTINCT {c}) = count({c}) AS is_unique,
       count(DISTINCT {c}) <> count({c}) AND count(DISTINCT {c}) < 20 AS is_grouping,
       regexp_matches('{c}', 'date|time')
         OR coalesce(typeof(any_value({c})) = 'VARCHAR'
                     AND len(string_split(CAST(arg_min({c}, o_orderkey) AS VARCHAR), '-')) = 3, false) AS is_match
FROM orders""") + """
UNION ALL
SELECT 'ship_note', count(DISTINCT n), count(n), true, count(DISTINCT n) = count(n),
       count(DISTINCT n) <> count(n) AND count(DISTINCT n) < 20,
       len(string_split(arg_min(n, o_orderkey), '-')) = 3
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS n FROM orders)
"""


def orders_with_note(spark, sf):
    return table(spark, sf, "orders").withColumn("ship_note", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("profile_key_candidates", KEY_CANDIDATES_SQL)
def profile_key_candidates(spark, sf):
    return P.key_candidates(orders_with_note(spark, sf), "o_orderkey")


def guidance_sql():
    names = [*ORDER_COLUMNS, "ship_note"]
    places = "[" + ", ".join(f"'{c}'" for c in names) + "]"
    lines = [
        f"(SELECT '{title}: ' || string_agg(\"column\", ', ' ORDER BY list_position({places}, \"column\")) || ' ({use})' FROM t WHERE {flag})"
        for flag, title, use in H.GUIDANCE
    ]
    return ", ".join([*lines, *(f"'{p}'" for p in H.PAIRING)])


@query("join_guidance", f"""
WITH t AS ({KEY_CANDIDATES_SQL})
SELECT 'join_guidance' AS chunk_id, 'join_patterns' AS type, concat_ws(chr(10), {guidance_sql()}) AS content
""")
def join_guidance(spark, sf):
    return H.join_guidance(orders_with_note(spark, sf), "o_orderkey")


def format_sql(c):
    return f"""
SELECT '{c}' AS "column", CASE
    WHEN len(string_split({c}, '-')) = 3 AND length(string_split({c}, '-')[1]) = 2
         AND length(string_split({c}, '-')[3]) = 2 THEN 'DD-XXX-YY'
    WHEN len(string_split({c}, '-')) = 3 AND length(string_split({c}, '-')[1]) = 4
         AND length(string_split({c}, '-')[2]) = 2 AND length(string_split({c}, '-')[3]) = 2 THEN 'YYYY-MM-DD'
    WHEN len(string_split({c}, '-')) = 3 THEN 'other dashed'
    WHEN contains({c}, '@') AND contains({c}, '.') THEN 'email-like'
    WHEN regexp_matches({c}, '^[0-9]+$') THEN 'numeric string'
    WHEN len(regexp_extract_all({c}, '\\S+')) = 1 THEN 'single word'
    ELSE 'multi-word text' END AS format FROM o"""


FORMAT_COLUMNS = ["o_orderpriority", "day", "short_day", "contact", "customer", "o_orderstatus"]


@query("format_profile", """
WITH o AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day,
                  strftime(o_orderdate, '%d-%b-%y') AS short_day, CAST(o_custkey AS VARCHAR) AS customer,
                  'c' || o_custkey || '@example.com' AS contact, o_orderstatus FROM orders),
f AS (""" + "\nUNION ALL\n".join(format_sql(c) for c in FORMAT_COLUMNS) + """)
SELECT "column", format, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "column"), 6) AS share
FROM f GROUP BY "column", format
""")
def format_profile(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "dd-MMM-yy").alias("short_day"),
        F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@example.com")).alias("contact"),
        F.col("o_custkey").cast("string").alias("customer"),
        "o_orderstatus",
    )
    return P.format_profile(orders).withColumn("share", F.round("share", 6))
