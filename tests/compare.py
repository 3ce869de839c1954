"""Compares registered queries with their SQL on a data directory: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from archspan.runtime import session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items())) 
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = str(p / "*.parquet") if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def compare(spark, con, sf_dir, name):
    """(rows equal or None without SQL, number of rows, seconds)."""
    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got), took, ""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    have = rows_of(df.columns, got)
    note = ""
    if sorted(columns) != sorted(df.columns):
        note = f"columns {sorted(df.columns)} vs {sorted(columns)}"
    elif have != want:
        a, b = set(map(repr, have)), set(map(repr, want))
        note = f"{len(have)} vs {len(want)} rows; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    return have == want and not note, len(got), took, note


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(cpus="8")
    con = tables(sf)
    for name in sys.argv[2:] or entry.queries():
        try:
            ok, n, took, note = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            ok, n, took, note = "ERROR", 0, 0, str(e)[:600]
        print(f"{name}: {ok} rows={n} {took:.1f}s {note}", flush=True)
