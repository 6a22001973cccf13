"""Registered queries: filters, joins, grouped and windowed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import relational as R
from gridlore.operators import sequences as Q
from gridlore.plans.registry import query
from gridlore.sources.tables import register, sample_rows, table

# ---- filters -------------------------------------------------------------------------------------


@query("filter_eq_and_or", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')
""")
def filter_eq_and_or(spark, sf):
    register(table(spark, sf, "orders"), "gl_orders")
    return spark.sql("""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM gl_orders
        WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')""")


@query("filter_compare", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_tax <= 0.05 AND l_extendedprice > 10000
  AND l_linenumber <> 3
""")
def filter_compare(spark, sf):
    c = F.col
    return (
        table(spark, sf, "lineitem")
        .where(
            (c("l_quantity") >= 45) & (c("l_discount") < 0.03) & (c("l_tax") <= 0.05)
            & (c("l_extendedprice") > 10000) & (c("l_linenumber") != 3)
        )
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    )


@query("filter_like", """
SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand ILIKE 'brand#1%' AND p_name ILIKE '%RING'
""")
def filter_like(spark, sf):
    return (
        table(spark, sf, "part")
        .where(R.like_any_case("p_brand", "brand#1%") & R.like_any_case("p_name", "%RING"))
        .select("p_partkey", "p_name", "p_brand")
    )


@query("filter_in_between_null", """
SELECT p_partkey, p_size, p_retailprice, nullif(p_type, 'PROMO') AS kind FROM part
WHERE p_size IN (1, 5, 9, 13, 17, 21) AND p_retailprice BETWEEN 950 AND 2000
  AND (nullif(p_type, 'PROMO') IS NULL OR nullif(p_brand, 'Brand#2') IS NOT NULL)
""")
def filter_in_between_null(spark, sf):
    kind = F.nullif("p_type", F.lit("PROMO"))
    brand = F.nullif("p_brand", F.lit("Brand#2"))
    return (
        table(spark, sf, "part")
        .where(
            F.col("p_size").isin(1, 5, 9, 13, 17, 21)
            & F.col("p_retailprice").between(950, 2000)
            & (kind.isNull() | brand.isNotNull())
        )
        .select("p_partkey", "p_size", "p_retailprice", kind.alias("kind"))
    )


@query("filter_above_average", """
SELECT p_partkey, p_retailprice FROM part
WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)
""")
def filter_above_average(spark, sf):
    return R.above_average(
        table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice"
    )


@query("filter_date_part", """
SELECT o_orderkey, o_totalprice, 'first quarter of 1997' AS part FROM orders
WHERE year(o_orderdate) = 1997 AND quarter(o_orderdate) = 1
UNION ALL
SELECT o_orderkey, o_totalprice, 'any January' AS part FROM orders WHERE month(o_orderdate) = 1
""")
def filter_date_part(spark, sf):
    orders = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_totalprice"]
    quarter = R.in_date_parts(orders, "o_orderdate", year=1997, quarter=1)
    january = R.in_date_parts(orders, "o_orderdate", month=1)
    return quarter.select(*cols, F.lit("first quarter of 1997").alias("part")).unionByName(
        january.select(*cols, F.lit("any January").alias("part"))
    )


@query("filter_last_30_days", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
""")
def filter_last_30_days(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.within_last(orders, "o_orderdate", "30 DAYS").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")
    )


@query("filter_within_24h", """
SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate BETWEEN o_orderdate - INTERVAL 24 HOUR AND o_orderdate + INTERVAL 24 HOUR
""")
def filter_within_24h(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.where(R.within_elapsed("l_shipdate", "o_orderdate", "24 HOURS")).select(
        "l_orderkey",
        "l_partkey",
        F.to_date("l_shipdate").alias("shipped"),
        F.to_date("o_orderdate").alias("ordered"),
    )


@query("typed_literal_filter", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey = 17 OR o_custkey IN (21, 35) OR (o_custkey >= 39.5 AND o_custkey < 45 AND o_custkey > -1)
  OR o_totalprice > 2.9e5 OR o_totalprice IN (SELECT min(o_totalprice) FROM orders) OR o_totalprice < -0.5
  OR (o_totalprice <= 100000.75 AND o_totalprice >= 99000.25)
""")
def typed_literal_filter(spark, sf):
    """Quoted whole numbers, decimals, negatives and exponents on a whole and on a fractional column."""
    orders = table(spark, sf, "orders")
    cheapest = str(orders.agg(F.min("o_totalprice")).first()[0])

    def is_(column, comparison, literal):
        return R.compare_quoted(orders, column, comparison, literal)

    chosen = (
        is_("o_custkey", "=", "17")
        | is_("o_custkey", "=", "17abc")
        | R.in_quoted(orders, "o_custkey", ["21", "35", "x", "20.5"])
        | (is_("o_custkey", ">=", "39.5") & is_("o_custkey", "<", "45") & is_("o_custkey", ">", "-1"))
        | is_("o_totalprice", ">", "2.9e5")
        | R.in_quoted(orders, "o_totalprice", [cheapest])
        | is_("o_totalprice", "<", "-0.5")
        | (is_("o_totalprice", "<=", "100000.75") & is_("o_totalprice", ">=", "99000.25"))
    )
    return orders.where(chosen).select("o_orderkey", "o_custkey", "o_totalprice")


# ---- joins ---------------------------------------------------------------------------------------


@query("join_inner", """
SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def join_inner(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", "o_totalprice"
    )


@query("join_bridge", """
SELECT p.p_name, s.s_name, l.l_orderkey, l.l_quantity
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")
def join_bridge(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("p_name", "s_name", "l_orderkey", "l_quantity")
    )


@query("self_join_same_value", """
SELECT s.s_suppkey, s.s_nationkey, count(*) AS partners,
       CASE WHEN s.s_suppkey < min(t.s_suppkey) THEN max(t.s_suppkey) ELSE min(t.s_suppkey) END AS partner
FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND s.s_suppkey <> t.s_suppkey
GROUP BY s.s_suppkey, s.s_nationkey
""")
def self_join_same_value(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return R.sharing_value(suppliers, "s_nationkey", "s_suppkey")


@query("self_join_pairs", """
SELECT a.user_id, a.event_type, a.event_id, min(b.event_id) AS next_event_id
FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id
GROUP BY a.user_id, a.event_type, a.event_id
""")
def self_join_pairs(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    paired = Q.with_next(
        events, ["user_id", "event_type"], ["event_id"], {"event_id": "next_event_id"}
    )
    return paired.where("next_event_id IS NOT NULL")


@query("pair_counts", """
SELECT a.user_id, a.event_type, (SELECT count(*) FROM events e
         WHERE e.user_id = a.user_id AND e.event_type = a.event_type) AS records, count(*) AS pairs
FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id
GROUP BY a.user_id, a.event_type
""")
def pair_counts(spark, sf):
    return R.pair_counts(
        table(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"]
    )


@query("repeat_within_interval", """
WITH p AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
           FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) AS purchases,
       count(*) FILTER (next_ts <= ts + INTERVAL 1 DAY) AS repeats FROM p GROUP BY user_id
""")
def repeat_within_interval(spark, sf):
    purchases = (
        table(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select("user_id", "ts", "event_id")
    )
    nxt = Q.with_next(purchases, ["user_id"], ["ts", "event_id"], {"ts": "next_ts"})
    return nxt.groupBy("user_id").agg(
        F.count("*").alias("purchases"),
        F.count_if(F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("repeats"),
    )


# ---- aggregates ----------------------------------------------------------------------------------


@query("agg_count", """
SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_finished,
       count(nullif(o_orderpriority, '5-LOW')) AS n_with_priority FROM orders
""")
def agg_count(spark, sf):
    return table(spark, sf, "orders").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
        F.count(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("n_with_priority"),
    )


@query("agg_basic", """
SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem
""")
def agg_basic(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.sum(R.money("l_quantity")).cast("double").alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
    )


@query("agg_group", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, round(avg(l_discount), 6) AS avg_disc
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_group(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(R.money("l_quantity")).cast("double").alias("sum_qty"),
            F.sum(R.money("l_extendedprice") * (1 - R.money("l_discount"))).cast("double").alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        )
    )


@query("agg_having_duplicates", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1
""")
def agg_having_duplicates(spark, sf):
    return R.duplicated_groups(table(spark, sf, "events"), ["user_id", "event_type"])


@query("sales_by_category", """
SELECT p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sales
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
""")
def sales_by_category(spark, sf):
    totals = R.total_by_dimension(
        table(spark, sf, "lineitem"),
        "l_partkey",
        R.money("l_extendedprice") * (1 - R.money("l_discount")),
        table(spark, sf, "part"),
        "p_partkey",
        "p_type",
        "sales",
    )
    return totals.select("p_type", F.col("sales").cast("double").alias("sales")).orderBy(F.col("sales").desc())


@query("agg_rate", """
SELECT o_orderpriority, count(*) AS n,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished_rate
FROM orders GROUP BY o_orderpriority
""")
def agg_rate(spark, sf):
    rates = R.rate_by(
        table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "finished_rate"
    )
    return rates.withColumn("finished_rate", F.round("finished_rate", 6))


@query("agg_binned", """
SELECT CAST(floor(p_size / 10) * 10 AS BIGINT) AS size_from, count(*) AS n,
       round(avg(p_retailprice), 6) AS avg_price FROM part GROUP BY 1
""")
def agg_binned(spark, sf):
    return (
        table(spark, sf, "part")
        .groupBy(R.binned("p_size", 10).cast("bigint").alias("size_from"))
        .agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("avg_price"))
    )


@query("agg_mode", """
SELECT o_orderstatus, o_orderpriority, n FROM (
  SELECT o_orderstatus, o_orderpriority, count(*) AS n,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r
  FROM orders GROUP BY o_orderstatus, o_orderpriority) WHERE r = 1
""")
def agg_mode(spark, sf):
    return R.most_common(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("agg_monthly_trend", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1
""")
def agg_monthly_trend(spark, sf):
    return R.monthly(
        table(spark, sf, "orders"),
        "o_orderdate",
        F.count("*").alias("n"),
        F.sum(R.money("o_totalprice")).cast("double").alias("total"),
    )


@query("group_leader", """
WITH g AS (SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand)
SELECT (SELECT count(*) FROM g) AS groups, p_brand AS leader, price AS leader_value
FROM g ORDER BY price DESC, p_brand LIMIT 1
""")
def group_leader(spark, sf):
    groups = (
        table(spark, sf, "part")
        .groupBy("p_brand")
        .agg(F.round(F.avg("p_retailprice"), 6).alias("price"))
    )
    return R.leading_group(groups, "p_brand", "price")


@query("group_summary", """
WITH g AS (SELECT c_mktsegment || '/' || c_nationkey AS segment, CAST(nullif(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS balance
           FROM customer GROUP BY 1)
SELECT segment, balance, row_number() OVER (ORDER BY balance DESC NULLS LAST, segment) AS place,
       row_number() OVER (ORDER BY balance DESC NULLS LAST, segment) = 1 AND balance IS NOT NULL AS leads, (SELECT count(*) FROM g) AS groups FROM g
""")
def group_summary(spark, sf):
    segment = F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("segment")
    groups = table(spark, sf, "customer").groupBy(segment).agg(F.nullif(F.sum(R.money("c_acctbal")), F.lit(0)).cast("double").alias("balance"))
    return R.group_summary(groups, "segment", "balance")


# ---- windows, sort, limit ------------------------------------------------------------------------


@query("top_per_group", """
WITH s AS (SELECT p_type, p_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, p_partkey)
SELECT p_type, p_partkey, sales FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY sales DESC, p_partkey) AS r FROM s) WHERE r = 1
""")
def top_per_group(spark, sf):
    per_part = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(R.money("l_extendedprice")).cast("double").alias("sales"))
    )
    sales = per_part.join(
        table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    best = R.top_per_group(sales, "p_type", [F.col("sales").desc(), F.col("p_partkey").asc()])
    return best.select("p_type", "p_partkey", "sales")


@query("trend_delta", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT month, total, lag(total) OVER (ORDER BY month) AS previous,
       round(total - lag(total) OVER (ORDER BY month), 2) AS change FROM m
""")
def trend_delta(spark, sf):
    months = R.monthly(
        table(spark, sf, "orders"), "o_orderdate", F.sum(R.money("o_totalprice")).cast("double").alias("total")
    )
    return R.change_from_previous(months, "month", "total").withColumn("change", F.round("change", 2))


@query("rolling_count", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id,
                  CASE WHEN event_id % 60 <> 0 THEN ts END AS ts FROM events)
SELECT event_id, user_id, CASE WHEN ts IS NOT NULL THEN count(*) OVER (PARTITION BY user_id, ts IS NULL ORDER BY ts
       RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) END AS events_7d FROM e
""")
def rolling_count(spark, sf):
    """Some events name no user, some no time."""
    events = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id"),
        F.expr("CASE WHEN event_id % 60 <> 0 THEN ts END AS ts"),
    )
    return Q.trailing_count(events, "user_id", "ts", "7 DAYS", "events_7d").drop("ts")


@query("sort_ranked", """
SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment, c_acctbal,
       row_number() OVER (ORDER BY nullif(c_acctbal, 0) ASC NULLS FIRST, c_custkey) AS position FROM customer
""")
def sort_ranked(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"), "c_acctbal"
    )
    balance = F.nullif("c_acctbal", F.lit(0.0))
    return Q.with_rank(customers, [balance.asc_nulls_first(), F.col("c_custkey").asc()], "position")


@query("top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def top_n(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("sample_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 3")
def sample_rows_query(spark, sf):
    return sample_rows(table(spark, sf, "part"), "p_partkey", 3)


# ---- sets ----------------------------------------------------------------------------------------


@query("union_all", """
SELECT 'customer' AS party, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
""")
def union_all(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.lit("customer").alias("party"),
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("party"),
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return customers.unionByName(suppliers)


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()
