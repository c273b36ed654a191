"""Runs queries and their SQL on the same tables and compares names, counts and values.

python -m tests.oracle [--dir FOLDER] [NAME...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int | float):
        return int(v) if float(v).is_integer() else float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 2")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, name: str, folder: str) -> str:
    """Empty if query and SQL agree, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows_of(names, rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main(args: list[str]) -> int:
    from tests.session import local

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        folder, args = args[1], args[2:]
    spark, con, failed = local(), connect(folder), 0
    for name in args or [q for q in entry.queries() if q != "pipeline" and not q.startswith("op")]:
        began = time.time()
        try:
            said = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001 - a report of all queries
            said = f"{type(e).__name__}: {str(e)[:400]}"
        failed += bool(said)
        kind = "" if name in entry.oracle_sql() else " (no SQL)"
        print(f"{'FAIL' if said else 'ok'} {name}{kind} {time.time() - began:.1f} s {said}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
