"""Compare registered queries with their SQL in DuckDB: `python -m tests.oracle [names…]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import math

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _norm(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 6) + 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sf_dir):
    started = time.time()
    df = query.build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - started
    if query.sql is None:
        return True, f"{len(got)} rows (rows only) {spark_s:.1f}s"
    started = time.time()
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    duck_s = time.time() - started
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    kinds_a = {c: type(v).__name__ for r in got for c, v in zip(df.columns, r) if v is not None}
    kinds_b = {c: type(v).__name__ for r in want for c, v in zip(names, r) if v is not None}
    if kinds_a != kinds_b:
        return False, f"types {kinds_a} != {kinds_b}"
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; {sorted(names)}\n   spark {only_a}\n   duck  {only_b}"
    return True, f"{len(got)} rows {spark_s:.1f}s duck {duck_s:.1f}s"


def main(names):
    from cuemill.plans import all_queries
    from cuemill.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, query in all_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note = compare(spark, con, query, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
