"""Order statistics against brute force; their plans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import scale


def rows(seed: int, n: int = 600):
    """One group holds about half of all rows; one value holds a third of that group."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.5 else rng.choice("abc")
        value = 5.0 if rng.random() < 0.33 else round(rng.uniform(-50, 50), 1)
        out.append((group, i, value, float(rng.randint(0, 9))))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "g string, id long, v double, w double")


def by_group(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_value_ranks(spark):
    data = rows(1)
    got = {(r.g, r.v): (r.n_before, r.n_eq, r.n_total) for r in scale.value_ranks(
        frame(spark, data), ["g"], "v").collect()}
    for g, members in by_group(data).items():
        values = [r[2] for r in members]
        for v in set(values):
            assert got[(g, v)] == (sum(x < v for x in values), values.count(v), len(values))


def test_large_groups_are_cut(spark):
    """No (group, range) window holds much more than its share of the cells."""
    cells = frame(spark, rows(2, 4000)).withColumn("u", F.col("v") + F.col("id") / 1e6)
    seen = {}
    keep = scale.stored
    scale.stored = lambda df, name: seen.setdefault(name, keep(df, name))
    try:
        scale.running_before(cells.withColumn("one", F.lit(1)), ["g"], "u", {"one": "n"}).count()
    finally:
        scale.stored = keep
    counts = seen["ranges"].groupBy("g", "__range").count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r["__range"] for r in counts}) == parts
    assert max(r["count"] for r in counts if r.g == "hot") <= 1.5 * len(rows(2, 4000)) / parts


def test_cube_places_by_several_columns(spark):
    """Ties, nulls, both directions and keys beyond double precision, all specs in one pass."""
    big = 1 << 60
    data = [("x", 2.0, big + 1), ("x", 2.0, big), ("x", -0.0, 5), ("x", 0.0, 4), ("x", None, 1),
            ("y", 1.0, 7), (None, 1.0, 8), (None, 3.0, None)]
    df = spark.createDataFrame(data, "g string, v double, k long")
    got = scale.rank_cube(df, {"a": (["g"], [("v", "desc"), ("k", "asc")]),
                               "b": ([], [("v", "asc")])}).collect()
    assert len(got) == len(data)
    for r in got:
        own = [d for d in data if d[0] == r.g and d[1] is not None and d[2] is not None]
        every = [d[1] for d in data if d[1] is not None]
        if r.v is None or r.k is None:
            assert (r.a_before, r.a_eq, r.a_total) == (None,) * 3
        else:
            ahead = sum((-d[1], d[2]) < (-r.v, r.k) for d in own)
            assert (r.a_before, r.a_eq, r.a_total) == (ahead, 1, len(own))
        if r.v is not None:
            assert (r.b_before, r.b_eq, r.b_total) == (
                sum(x < r.v for x in every), every.count(r.v), len(every))


def test_rows_without_a_value(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 3.0), ("y", None)],
                               "g string, v double")
    got = {(r.g, r.v): (r.r_before, r.r_eq, r.r_total)
           for r in scale.with_value_ranks(df, ["g"], "v", "r").collect()}
    assert got == {("x", 1.0): (0, 1, 2), ("x", 3.0): (1, 1, 2), ("x", None): (None,) * 3,
                   ("y", None): (None,) * 3}


def test_one_plan_without_one_task_windows(spark):
    """The same plan on every call, no job while it is built, no window over an empty key."""
    import re

    df = frame(spark, rows(7))
    plans = set()
    for _ in range(3):
        out = scale.exact_quantiles(scale.with_value_ranks(df, [], "v", "r"), [], "w", (0.5,))
        text = out._jdf.queryExecution().optimizedPlan().toString()
        plans.add(re.sub(r"\d+", "", text))
        windows = re.findall(r"Window \[.*", text)
        assert windows and all("__range" in w for w in windows)
    assert len(plans) == 1


def test_null_group_and_global_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 1.0), (None, 2.0)],
                               "g string, v double")
    got = {(r.g, r.v): r.n_before for r in scale.value_ranks(
        df, ["g"], "v").collect()}
    assert got == {(None, 1.0): 0, (None, 2.0): 1, ("x", 1.0): 0}
    whole = {r.v: (r.n_before, r.n_eq) for r in scale.value_ranks(
        df, [], "v").collect()}
    assert whole == {1.0: (0, 2), 2.0: (2, 2)}


def test_row_ranks_and_positions(spark):
    data = rows(3)
    ranked = scale.with_value_ranks(frame(spark, data), ["g"], "v", "r")
    placed = scale.row_positions(ranked, ["g"], [("v", "desc"), ("id", "asc")], "pos").collect()
    assert len(placed) == len(data)
    for g, members in by_group(data).items():
        order = sorted(members, key=lambda r: (-r[2], r[1]))
        mine = {r.id: r for r in placed if r.g == g}
        for pos, r in enumerate(order):
            assert mine[r[1]].pos == pos
            assert mine[r[1]].r_before == sum(m[2] < r[2] for m in members)
            assert mine[r[1]].r_eq == sum(m[2] == r[2] for m in members)
            assert mine[r[1]].r_total == len(members)


@pytest.mark.parametrize("levels", [(0.0, 0.01, 0.25, 0.5, 0.9, 1.0)])
def test_exact_quantiles(spark, levels):
    data = rows(4)
    got = {r.g: r.quantiles for r in scale.exact_quantiles(
        frame(spark, data), ["g"], "v", levels).collect()}
    for g, members in by_group(data).items():
        want = np.quantile([r[2] for r in members], levels)
        np.testing.assert_allclose(got[g], want, atol=1e-12)
    whole = scale.exact_quantiles(frame(spark, data), [], "v", levels).first().quantiles
    np.testing.assert_allclose(whole, np.quantile([r[2] for r in data], levels), atol=1e-12)


def test_pairs_without_pairs(spark):
    data = rows(5, 250)
    got = {r.g: (r.n, r.concordant) for r in scale.order_code_pairs(
        frame(spark, data), ["g"], "v", "w").collect()}
    for g, members in by_group(data).items():
        agree = sum((a[2] - b[2]) * (a[3] - b[3]) > 0
                    for i, a in enumerate(members) for b in members[:i])
        assert got[g] == (len(members), agree)


def test_keep_one_and_top_n(spark):
    data = rows(6)
    kept = scale.keep_one(frame(spark, data), ["g"], [F.col("v").desc(), F.col("id")]).collect()
    for g, members in by_group(data).items():
        best = min(members, key=lambda r: (-r[2], r[1]))
        assert [r.id for r in kept if r.g == g] == [best[1]]
    plan = scale.top_n(frame(spark, data), ["g"], [F.col("v")], 3)._jdf.queryExecution()
    assert "WindowGroupLimit" in plan.toString()      # limited before the shuffle
