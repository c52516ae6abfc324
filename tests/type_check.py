"""Column types of every query and of its SQL: ``python tests/type_check.py``."""

import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle_check import DATA, duck, session  # noqa: E402

SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def main():
    from __spark_entry__ import oracle_sql, queries
    sf_dir = f"{DATA}/sf0.001"
    spark, con, sqls, bad = session("briefloom types"), duck(sf_dir), oracle_sql(), 0
    for name, sql in sqls.items():
        want = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
        got = {c: SAME.get(t, t) for c, t in queries()[name](spark, sf_dir).dtypes}
        if got != want:
            bad += 1
            print(name, {c: (got.get(c), want.get(c)) for c in {*got, *want} if got.get(c) != want.get(c)}, flush=True)
    print("types differ:", bad)


if __name__ == "__main__":
    main()
