"""Run queries next to their oracle SQL: ``python -m contract.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from .session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6)
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: repr(r)
    )


def compare(spark, con, sf_dir, query, sql):
    """(problem or None, number of rows)."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(got)
    if got == want:
        return None, len(got)
    left, right = set(got), set(want)
    a, b = [r for r in got if r not in right], [r for r in want if r not in left]
    text = f"rows {len(got)} / {len(want)}\n   got  {a[:2]}\n   want {b[:2]}"
    return text, len(got)


def main():
    from .queries import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark, con = local_session(), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem, n = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problem, n = None, f"{QUERIES[name](spark, sf_dir).count()} (rows only)"
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        bad += problem is not None
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s {n}", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
