"""Compare queries with their SQL: ``python tests/check.py [sf_dir] [name ...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    return str(v)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, build, sql, sf_dir):
    """None when equal, else what differs."""
    df = build(spark, sf_dir)
    cols, rows = normal_rows(df.columns, [tuple(x) for x in df.collect()])
    rel = con.sql(sql)
    want_cols, want = normal_rows(rel.columns, rel.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from odolog.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        try:
            n = 0
            if name not in oracles:
                problem = None if (n := queries[name](spark, sf).count()) else "no rows"
            else:
                problem = compare(spark, con, queries[name], oracles[name], sf)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)}")
