"""Run registered queries next to their SQL in DuckDB: python -m checks.compare [sf] [name part…]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return repr(float(value)) if float(value) != int(value) else str(int(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir, name, query, sql, con=None):
    start = time.time()
    got = query(spark, sf_dir)
    data = got.collect()
    took = time.time() - start
    if sql is None:
        return len(data) > 0, f"{len(data)} rows (rows only)", took
    cursor = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} <> {sorted(names)}", took
    left, right = rows_of(got.columns, data), rows_of(names, want)
    if left == right:
        return len(left) > 0, f"{len(left)} rows", took
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return False, f"{len(left)} / {len(right)} rows; {str(only_left)[:600]} <> {str(only_right)[:600]}", took


def main() -> None:
    from checks import all_queries, all_sql
    from pairloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"{TABLES}/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name, query in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            ok, note, took = compare(spark, sf_dir, name, query, sql.get(name), con)
        except Exception as error:  # report and go on with the next query
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
