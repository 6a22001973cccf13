"""The registered corpus queries, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import (
    exact_dedup, filter_audit, licenses, line_dedup, mixing, packing, quality, simhash, suffix_dedup, token_counts, topk, url_filter, whitening,
)
from gridlore.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256, CAST(octet_length(encode(n)) AS BIGINT) AS n_bytes
FROM t WINDOW w AS (PARTITION BY n)
""")
def op1_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes"
    )


@query("op2_source_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS most FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER b, 0) AS l,
             (SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS n
      FROM w WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, first_value(CASE WHEN most / w > l / n THEN {'l': l, 'n': n} END IGNORE NULLS)
                OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM f),
p AS (SELECT source, source_size, CASE WHEN open IS NULL THEN CAST(most AS DOUBLE)
             ELSE CAST(w * open.l AS DOUBLE) / CAST(open.n AS DOUBLE) END AS target,
             CAST(('0x' || substr(md5('mix/' || coalesce(source, '/null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM g),
e AS (SELECT *, coalesce(target / nullif(source_size, 0), 0.0::DOUBLE) AS expected FROM p),
r AS (SELECT d.doc_id, d.size, e.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS k
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       CAST(floor(CAST(k AS DOUBLE) * expected + start) - floor(CAST(k - 1 AS DOUBLE) * expected + start) AS BIGINT) * size AS taken
FROM r
""")
def op2_source_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op3_repeated_strings")
def op3_repeated_strings(spark, sf):
    return suffix_dedup.without_repeats(table(spark, sf, "documents")).drop("kept")


@query("op4_simhash")
def op4_simhash(spark, sf):
    return simhash.near_groups(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op5_token_counts")
def op5_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"))


@query("op6_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op6_topk_search(spark, sf):
    return topk.search(table(spark, sf, "embeddings"))


def _term_sql(terms: tuple[str, ...]) -> str:
    """The number of terms that stand in a URL in a form that is theirs."""
    owner = {f: t for t in reversed((*url_filter.STRICT, *url_filter.SOFT)) for f in url_filter.forms(t)}
    own = {t: "|".join(f for f in url_filter.forms(t) if owner[f] == t) for t in terms}
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9])({f})([^a-z0-9]|$)') AS INTEGER)" for f in own.values() if f)


_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{h}{p}', '{what}']"
    for what, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
)


@query("op7_url_filter", f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url,
                  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
p AS (SELECT *, regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
             {_term_sql(url_filter.STRICT)} AS strict_hits, {_term_sql(url_filter.SOFT)} AS soft_hits FROM u),
r AS (SELECT *, CASE {_RULE_SQL} END AS rule_verdict FROM p)
SELECT page_id, host, path, rule_verdict[1] AS rule,
       coalesce(rule_verdict[2], CASE WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM r
""")
def op7_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@query("op8_quality_rules")
def op8_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf, "labels")))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op10_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) > 1 AND l3 IS NOT NULL AS again FROM w),
k AS (SELECT *, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS gone
      FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id
""")
def op10_line_dedup(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents")).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.col("_text").alias("text"),
    )


@query("op11_whitening")
def op11_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_filter_audit", r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part,
             CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
c AS (SELECT f.part, f.fails, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic
      FROM f LEFT JOIN labels l USING (doc_id) GROUP BY f.part, f.fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT *, contains(fails, letter) AS hit, before <> '' AND fails <> '' AND regexp_matches(before, '[' || fails || '0]') AS gone FROM c, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
             coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
      FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
""")
def op12_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _template_sql() -> str:
    """A row per word of every template: number, label, base, place, word, whether a key phrase holds that place."""
    rows = []
    for n, t in enumerate((*licenses.BASE, *licenses.PASSAGES)):
        needed = {at + i for at, words in t.phrases() for i in range(len(words))}
        rows += [f"({n}, '{t.label}', {str(t.base).lower()}, {p}, '{w}', {str(p in needed).lower()})" for p, w in enumerate(t.words())]
    return ", ".join(rows)


@query("op13_license_scan", rf"""
WITH t(tpl, label, base, p, word, needed) AS (VALUES {_template_sql()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
v AS (SELECT * FROM w WHERE word IN (SELECT word FROM t)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM v GROUP BY word),
h AS (SELECT v.doc_id, v.word, v.pos, t.tpl, t.p, df.n FROM v JOIN t USING (word) JOIN df USING (word)),
q AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, tpl ORDER BY n, word) AS rare FROM h),
c AS (SELECT doc_id, tpl, pos - p AS start FROM q WHERE rare <= {licenses.RARE} GROUP BY doc_id, tpl, pos - p HAVING count(DISTINCT word) >= 2),
m AS (SELECT c.doc_id, c.tpl, c.start, any_value(t.label) AS label, any_value(t.base) AS base, count(*) AS size,
             count(v.word) AS found, count(*) FILTER (t.needed) AS needed, count(v.word) FILTER (t.needed) AS held
      FROM c JOIN t ON c.tpl = t.tpl LEFT JOIN v ON v.doc_id = c.doc_id AND v.pos = c.start + t.p AND v.word = t.word
      GROUP BY c.doc_id, c.tpl, c.start),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(CAST(found AS DOUBLE) / CAST(size AS DOUBLE)) AS score
      FROM m WHERE needed = held GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)
""")
def op13_license_scan(spark, sf):
    return licenses.labelled(table(spark, sf, "documents"))
