"""Runs registered queries in Spark and their SQL in DuckDB and compares the results.

    python check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL, {spent:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(got[1])} rows, {spent:.1f}s, sql {time.time() - t:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        kinds = {}
        for r, s in zip(got[1], want[1]):
            for c, a, b in zip(got[0], r, s):
                if type(a) is not type(b):
                    kinds[c] = (type(a).__name__, type(b).__name__)
        return not kinds, note + (f" types {kinds}" if kinds else "")
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return False, f"{note}; {len(want[1])} wanted\n   only spark: {sorted(a - b)[:3]}\n   only sql:   {sorted(b - a)[:3]}"


def session(cpus: str = "8"):
    from eventide.session import build

    return build(
        f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )


def main() -> int:
    from eventide.queries import registry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark, con = session(), duck(a.sf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = registry.queries(), registry.oracle_sql()
    bad = []
    for name in a.names or queries:
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), a.sf)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
