"""Run registered queries next to their SQL twins and compare rows, types and values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from parcelspark.session import build_session, clear_staged  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    seconds = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
        return "QUADRATIC PLAN", len(rows), seconds
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), len(rows), seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = [names.index(c) for c in sorted(names)]
    expected = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    mine = {c: KINDS.get(t, t) for c, t in df.dtypes}
    if mine != types:
        return f"TYPES {sorted(set(mine.items()) ^ set(types.items()))}", len(rows), seconds
    if len(rows) != len(expected):
        return f"COUNT {len(rows)} != {len(expected)}", len(rows), seconds
    differing = set(rows) ^ set(expected)
    if differing or sorted(map(repr, rows)) != sorted(map(repr, expected)):
        return f"VALUES {len(differing)}: {sorted(differing, key=repr)[:4]}", len(rows), seconds
    return "ok", len(rows), seconds


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, connection = build_session("compare"), connect(sf)
    bad = 0
    for query in sys.argv[2:] or entry.queries():
        try:
            verdict, n, took = compare(session, connection, sf, query)
        except Exception as problem:
            verdict, n, took = f"FAILED {type(problem).__name__}: {str(problem)[:600]}", 0, 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{query:26s} {n:8d} {took:6.1f}s  {verdict}", flush=True)
    clear_staged(session)
    sys.exit(bad)
