"""Compare registered queries with their SQL on the same tables.

Run by hand:  python -m tests.oracle [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return repr(float(v)) if isinstance(v, decimal.Decimal) else repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, q):
    df = q.run(spark, sf_dir)
    t0 = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if not q.sql:
        return True, f"{len(got[1])} rows (no SQL)", took
    cur = con.execute(q.sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if got[1] != want[1]:
        g, w = set(got[1]), set(want[1])
        return False, f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(g - w)[:3]}; only sql {sorted(w - g)[:3]}", took
    return True, f"{len(got[1])} rows", took


def main(argv):
    from recfuse import build_session
    from recfuse.registry.load import QUERIES

    sf = argv[0] if argv else "0.001"
    names = argv[1:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", 8, {"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, note, took = compare(spark, con, sf_dir, QUERIES[n])
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:1200]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {took:6.2f}s  {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
