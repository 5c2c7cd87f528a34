"""The queries that SQL can express against their SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(
    os.path.abspath(__file__)))), "tools"))

from compare import TABLES, rows_of  # noqa: E402

from panelspark.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [d[0] for d in cur.description], cur.fetchall())
