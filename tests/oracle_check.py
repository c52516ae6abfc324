"""Compare registered queries with their DuckDB SQL: ``python tests/oracle_check.py [--sf 0.01] [name part ...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from briefloom.sources.samples import TABLES  # noqa: E402

DATA = "/root/testdata"


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(canon(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """(problem or None, spark rows, spark seconds, duckdb seconds)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    problem = None
    if a[0] != b[0]:
        problem = f"columns {a[0]} != {b[0]}"
    elif a[1] != b[1]:
        extra, missing = list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3]
        problem = f"rows {sum(a[1].values())} vs {sum(b[1].values())}\n  spark only: {extra}\n  duckdb only: {missing}"
    return problem, len(got), t1 - t0, t2 - t1


def session(name="briefloom check"):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName(name)
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--rows-only", action="store_true", help="also run queries without SQL")
    ap.add_argument("parts", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries
    sf_dir = f"{DATA}/sf{args.sf}"
    spark, con, sqls, bad = session(), duck(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if args.parts and not any(p in name for p in args.parts):
            continue
        if name not in sqls and not (args.rows_only or args.parts):
            continue
        try:
            problem, n, ts, td = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # report and go on
            problem, n, ts, td = f"{type(e).__name__}: {str(e)[:900]}", -1, 0, 0
        state = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{state} {name:45s} rows={n:<8d} spark={ts:6.2f}s duckdb={td:5.2f}s", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem[:1500], flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
