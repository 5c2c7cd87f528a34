"""Registered queries against their SQL, and the shape of some plans."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

from compare import TABLES, rows_of  # noqa: E402

from panelspark.plans import all_queries  # noqa: E402

# One query per family; tools/compare.py runs them all.
SAMPLE = ("panel_rolling", "feature_store", "dedupe_last", "rolling_windows", "diverse_pool",
          "flags", "hygiene", "h2h_record", "h2h_dist", "pair_cov_opponent", "concordance",
          "tail_comparison", "quantile_vectors", "cdf_grid", "best_xi", "settlement", "h2h_table",
          "ownership_latest", "difficulty", "best_swap")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    q = all_queries()[name]
    df = q(spark, sf)
    cur = duck.execute(q.sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_a_stable_schema(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(math.isnan(len(n)) or "." in n for n in entry.queries())
    assert entry.entry(spark).columns == list(
        all_queries()["feature_store"](spark, sf).columns)


def test_scans_read_only_what_they_need(spark, sf):
    plan = all_queries()["panel_rolling"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    plan = all_queries()["latest_price"](spark, sf)._jdf.queryExecution().toString()
    assert "props" not in plan.split("Physical Plan")[1]


def test_no_cross_joins(spark, sf):
    for name in ("h2h_record", "concordance", "pair_cov_same", "entity_pair_corr", "best_swap"):
        plan = all_queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
