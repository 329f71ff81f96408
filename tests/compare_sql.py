"""Run every registered query and its SQL twin; print what differs.

Usage: python tests/compare_sql.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from skirmish.session import build_session  # noqa: E402

TABLES = [
    "events", "lineitem", "orders",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def canonical(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return type(a) is type(b) and a == b


def difference(spark, db, name: str, sf_dir: str) -> str | None:
    """None when the query and its SQL twin agree in columns, types and rows."""
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want, strict=True):
        if not all(same(x, y) for x, y in zip(g, w, strict=True)):
            return f"{dict(zip(sorted(columns), g))}\n   != {dict(zip(sorted(columns), w))}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duck(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            diff = difference(spark, db, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{name:28s} {time.time() - began:6.2f}s {'ok' if diff is None else 'DIFF ' + diff}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
