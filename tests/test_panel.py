from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark.operators import checks as C
from panelspark.operators import panel as P
from panelspark.operators import pool as PL

POINTS = {430: [13, 2, 4, 1], 239: [9, 5, 3, 2]}


@pytest.fixture(scope="module")
def world(spark):
    stats = [(pid, gw + 1, p) for pid, ps in POINTS.items() for gw, p in enumerate(ps)]
    return {
        "stats": spark.createDataFrame(stats, "player_id long, gw long, total_points long"),
        "players": spark.createDataFrame(
            [(430, 1430, 43), (239, 1239, 3)], "player_id long, player_code long, team_code long"),
        "history": spark.createDataFrame(
            [(239, 1, 43), (239, 2, 43)], "player_id long, gw long, team_code long"),
        "matches": spark.createDataFrame([
            ("m1", 1, 43, 3, 2064.0, 1991.0, "prem"), ("m2", 2, 3, 43, 1991.0, 2064.0, "prem"),
            ("m2b", 2, 7, 43, 1.0, 2.0, "cup"), ("m3", 3, 43, 8, 2064.0, 1700.0, "prem"),
            ("m0", 3, 9, 43, 5.0, 6.0, "prem")],
            "match_id string, gw long, home_team long, away_team long, home_team_elo double, "
            "away_team_elo double, tournament string").withColumns(
            {"home_score": F.lit(1), "away_score": F.lit(0)}),
    }


def build(world, carry=None):
    return P.build_features(world["stats"], world["history"], world["matches"],
                            world["players"], carry)


def test_features(world):
    rows = {(r.player_id, r.gw): r for r in build(world).collect()}
    assert {k[1] for k in rows} == {2, 3, 4}
    r = rows[(430, 3)]
    assert (r.prev_points, r.pts_avg_3, r.pts_avg_5, r.next_points) == (2, 7.5, 7.5, 1)
    r = rows[(430, 2)]
    assert (r.opponent_team_code, r.was_home, r.home_elo, r.opponent_elo) == (
        3, False, 2064.0, 1991.0)
    assert rows[(430, 3)].opponent_team_code == 8           # the home one of two fixtures
    assert rows[(430, 4)].next_points is None and rows[(430, 4)].opponent_team_code is None
    assert rows[(239, 2)].team_code == 43 and rows[(239, 3)].team_code == 3


def test_carryover(world, spark):
    carry = P.carryover_seed(build(world))
    seed = {r.player_code: r for r in carry.collect()}
    assert seed[1430].prev_points == 4 and seed[1430].pts_avg_3 == pytest.approx(19 / 3)
    rows = {(r.player_id, r.gw): r for r in build(world, carry).collect()}
    assert rows[(430, 1)].prev_points == 4
    assert rows[(430, 2)].prev_points == 13


def test_leakage_gate(world, spark):
    features = build(world)
    split = C.Split(2, 3, 2, 3)
    C.validate_leakage(features, world["players"], split)
    broken = features.withColumn("next_points", F.col("next_points") + 1)
    with pytest.raises(ValueError, match="target_is_next_row"):
        C.validate_leakage(broken, world["players"], split)
    other = world["players"].withColumn("player_code", F.col("player_code") + 1)
    with pytest.raises(ValueError, match="identity_on_stable_code"):
        C.validate_leakage(features, other, split)
    with pytest.raises(ValueError, match="fit_gw_max=3 must be before test_start=3"):
        C.validate_leakage(features, world["players"], C.Split(3, 4, 3, 3))


def test_role_rates_keep_their_divisor(spark):
    df = spark.createDataFrame([(1, 1, 90, 1), (1, 2, 120, 0), (1, 3, None, 1)],
                               "player_id long, gw long, minutes long, starts long")
    last = P.role_rates(df).where("gw = 3").first()
    assert (last.appear_rate_5, last.start_rate_5, last.minutes_share_5) == (0.4, 0.4, 0.4)


def test_union_keep(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    b = spark.createDataFrame([(1, "c", 2)], "k int, v string, o int")
    first = {r.k: r.v for r in P.union_keep([a, b], ["k"], ["o"]).collect()}
    last = {r.k: r.v for r in P.union_keep([a, b], ["k"], ["o"], "last").collect()}
    assert first == {1: "a", 2: "b"} and last == {1: "c", 2: "b"}


def test_form_rules_differ(spark):
    df = spark.createDataFrame([(1, g, float(p)) for g, p in enumerate([9, 8, 7, 6, 5, 1])],
                               "player_id long, gw long, total_points double")
    assert P.form_of_largest(df).first().form == 7.0
    assert P.form_of_latest(df).first().form == pytest.approx(27 / 5)


def test_normalize_forecast(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "player_code long, gw long, pred double")
    assert P.normalize_forecast(df).columns == ["player_code", "gw", "expected_points"]
    with pytest.raises(P.SchemaError):
        P.normalize_forecast(df.drop("gw"))
    with pytest.raises(P.SchemaError):
        P.normalize_forecast(df, "distribution")


def test_rolling_windows_match_a_range_join(spark):
    df = spark.range(1, 31).withColumnRenamed("id", "gw")
    got = {(r.gw, r.window) for r in C.with_rolling_windows(df, 5, 20, 4, 3).collect()}
    windows = C.rolling_windows(5, 20, 4, 3)
    want = {(g, i) for g in range(1, 31) for i, s in enumerate(windows)
            if s.test_start <= g <= s.test_end}
    assert got == want
    with pytest.raises(ValueError):
        C.rolling_windows(5, 6, 4)


def test_split_order_is_checked(spark):
    with pytest.raises(ValueError):
        C.with_split(spark.range(3).withColumnRenamed("id", "gw"), C.Split(5, 4, 6, 7))


def test_filter_pool(spark):
    import random
    rng = random.Random(3)
    people = [(i, rng.choice(["GKP", "DEF"]), rng.randint(1, 4), float(rng.randint(0, 30)))
              for i in range(120)]
    scored = spark.createDataFrame(
        people, "player_code long, position string, team_code long, expected_total double")
    avail = spark.createDataFrame(
        [(i, 0 if i % 10 == 0 else 90, None if i % 17 == 0 else 5.0) for i in range(120)],
        "player_code long, minutes_in_window long, now_cost double")
    got = {r.player_code for r in PL.filter_pool(
        scored, avail, top_k_per_position=20, max_per_team=5, reserve_top=8).collect()}
    pool = [p for p in people if p[0] % 10 and p[0] % 17]
    pool.sort(key=lambda p: (-p[3], p[0]))
    kept, rest = pool[:8], pool[8:]

    def cut(rows, at, k):
        out = []
        for r in rows:
            peers = [x[3] for x in rows if x[at] == r[at]]
            rank = sum(x > r[3] for x in peers) + (peers.count(r[3]) + 1) / 2
            if rank <= k:
                out.append(r)
        return out

    want = {p[0] for p in kept} | {p[0] for p in cut(cut(rest, 1, 20), 2, 5)}
    assert got == want


def test_search_space(spark):
    df = spark.createDataFrame([(p,) for p, n in [("GKP", 4), ("DEF", 8), ("MID", 8), ("FWD", 5)]
                                for _ in range(n)], "position string")
    import math
    want = math.log10(math.comb(4, 2) * math.comb(8, 5) ** 2 * math.comb(5, 3))
    assert PL.search_space_size(df).first().log10_teams == pytest.approx(want)
    with pytest.raises(Exception, match="need 2"):
        PL.search_space_size(df.where("position <> 'GKP'")).collect()


def test_pages_keep_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "player_code long, x double")
    order = lambda **kw: [r.player_code for r in PL.ranked_page(df, "x", **kw).collect()]
    assert order() == [3, 2, 1] and order(descending=True) == [2, 3, 1]
    assert order(limit=1, offset=1) == [2]
    with pytest.raises(ValueError):
        PL.ranked_page(df, "x", sortable=("y",))
