"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0 if v != int(v) or abs(v) > 1e15 else float(int(v))
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return [] if got[1] else [f"{name}: no rows"]
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    problems = []
    if got[0] != want[0]:
        problems.append(f"{name}: columns {got[0]} vs {want[0]}")
    if len(got[1]) != len(want[1]):
        problems.append(f"{name}: rows {len(got[1])} vs {len(want[1])}")
    if not want[1]:
        problems.append(f"{name}: oracle has no rows")
    if not problems:
        bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if repr(g) != repr(w)]
        if bad:
            problems.append(f"{name}: {len(bad)}/{len(want[1])} rows differ, first {bad[0][0]} vs {bad[0][1]}")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from plumbline.queries import ORACLES, QUERIES
    from plumbline.session import build_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            problems = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as exc:  # report and go on with the next query
            problems = [f"{name}: {type(exc).__name__} {str(exc)[:900]}"]
        took = time.time() - start
        print(f"{'FAIL' if problems else 'ok  '} {took:6.2f}s {name}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
        bad += bool(problems)
    print("failed:", bad)
