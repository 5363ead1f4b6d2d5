"""Compare registered queries with their SQL on one folder of tables: ``python tests/check.py DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in at) for r in rows), sorted(columns)


TIMES: dict[str, float] = {}


def compare(spark, con, sf_dir, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    ref = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in ref.description], ref.fetchall())
    TIMES["sql"] = time.time() - start - TIMES["spark"]
    if cols != want_cols:
        return f"columns {cols} instead of {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    if got == want:
        return None
    more, less = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(more)} rows differ, e.g. {more[:2]} instead of {less[:2]}"


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from shardflow.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n = queries[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        took = f"{time.time() - start:6.2f}s (sql {TIMES.get('sql', 0):.2f}s)"
        print(f"{name:22s} {'sql' if name in oracles else 'rows':4s} {took} {problem or 'ok'}", flush=True)
    print("failed", failed, "of", len(names or queries), "with sql", len(oracles))


if __name__ == "__main__":
    main(*sys.argv[1:])
