"""Run registered queries in Spark and their SQL in DuckDB and compare names, types, rows and values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def compare(spark_df, con, sql: str) -> str:
    """Empty when both sides agree, otherwise what differs."""
    names = sorted(spark_df.columns)
    mine = [tuple(cell(v) for v in r) for r in spark_df.select(*[f"`{c}`" for c in names]).collect()]
    cur = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    order = [d[0] for d in cur.description]
    if sorted(desc) != names:
        return f"columns {names} / {sorted(desc)}"
    ix = [order.index(c) for c in names]
    theirs = [tuple(cell(r[i]) for i in ix) for r in rows]
    problems = []
    types = dict(spark_df.dtypes)
    for c in names:
        if SPARK_TO_DUCK.get(types[c], types[c]) != desc[c]:
            problems.append(f"type of {c}: {types[c]} / {desc[c]}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    a, b = Counter(mine), Counter(theirs)
    if a != b:
        more, less = list((a - b).elements()), list((b - a).elements())
        key = lambda r: tuple(str(x) for x in r)
        problems.append(f"{len(more)} only in spark, {len(less)} only in sql; columns {names}")
        for r in sorted(more, key=key)[:2]:
            problems.append(f"   spark {str(r)[:600]}")
        for r in sorted(less, key=key)[:2]:
            problems.append(f"   sql   {str(r)[:600]}")
    return "\n".join(problems)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from gridlore.session import get_session

    folder = argv[0]
    wanted = argv[1:]
    spark = get_session("oracle-check")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = df.count()
                problem = "" if n else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{bad} failed of {len(queries)} queries, {len(sqls)} with SQL")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
