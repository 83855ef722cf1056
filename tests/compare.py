"""Run registered queries beside their SQL: ``python tests/compare.py [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, order):
    def value(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, function, sql, folder):
    """Returns (problem or None, rows)."""
    df = function(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return (None if rows else "no rows"), len(rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(rows)
    left = canonical(rows, [df.columns.index(c) for c in sorted(names)])
    right = canonical(expected, [names.index(c) for c in sorted(names)])
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}", len(rows)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0][0]} against {wrong[0][1]}", len(rows)
    return None, len(rows)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from quantgap.session import get_session

    if os.environ.get("ROWS_PER_SLICE"):  # force the path for large tables
        from quantgap.operators import samples

        samples.plan_slices.__defaults__ = (int(os.environ["ROWS_PER_SLICE"]),)
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    chosen = sys.argv[1:] or list(queries())
    oracles = oracle_sql()
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            problem, count = compare(spark, con, name, queries()[name], oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {kind:4s} {count:7d} {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print("all good" if not bad else f"{bad} problems")
