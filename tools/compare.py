"""Run queries on Spark and their SQL on DuckDB over the same files and compare the rows.

usage: compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.plans import all_queries  # noqa: E402
from panelspark.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return f"f{v!r}"
    return f"{type(v).__name__}{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = []
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as err:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: spark {type(err).__name__} {str(err)[:700]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got[1])} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            cur = con.execute(q.sql)
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as err:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: duckdb {str(err)[:700]}", flush=True)
            continue
        duck = time.time() - start
        if got == want:
            print(f"ok   {name}: {len(got[1])} rows spark {took:.1f}s duck {duck:.1f}s",
                  flush=True)
            continue
        failed.append(name)
        print(f"FAIL {name}: {len(got[1])} rows, expected {len(want[1])}; columns "
              f"{got[0]} / {want[0]}", flush=True)
        a, b = set(got[1]), set(want[1])
        print("   spark only ", sorted(a - b)[:3], len(a - b))
        print("   duckdb only", sorted(b - a)[:3], len(b - a), flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
