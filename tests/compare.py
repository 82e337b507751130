"""Runs registered queries beside their SQL twins in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(x)) for k, x in value.items()))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(canonical(x) for x in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, q, folder: str):
    """(ok, note)"""
    start = time.time()
    df = q.run(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if q.sql is None:
        return True, f"rows only: {len(got)} rows, {spent:.1f}s"
    start = time.time()
    cur = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck = time.time() - start
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first:\n   spark {bad[0][0]!r:.600}\n   sql   {bad[0][1]!r:.600}"
    return True, f"{len(got)} rows, spark {spent:.1f}s, sql {duck:.1f}s"


def main() -> None:
    from uttera.catalog import REGISTRY
    from uttera.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(REGISTRY)
    spark, con = local_session("compare"), connect(folder)
    failed = []
    for name in wanted:
        try:
            ok, note = compare(spark, con, REGISTRY[name], folder)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} ok; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
