"""Steps whose memory, shuffle or time once grew faster than their input."""

import inspect

import pytest
from pyspark.sql import functions as F

from panelspark.functions import quantiles as Q
from panelspark.operators import cooccur as CO
from panelspark.operators import h2h as H
from panelspark.operators import scale
from panelspark.operators import squads as SQ
from panelspark.operators import swaps as SW
from panelspark.sources import season_files as FILES
from panelspark.sources import tree as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealing_follows_the_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    few = scale.dealt(df, 10, "k").rdd.getNumPartitions()
    many = scale.dealt(df, scale.ROWS_A_TASK * (few + 5), "k").rdd.getNumPartitions()
    assert many == few + 5


def test_settlement_reads_the_forecast_in_place(spark):
    rows = [(1, 1, 10, 1, "DEF", True, False, True, 3.0, 2.0),
            (1, 1, 11, 2, "MID", False, True, False, 9.0, 5.0),
            (1, 1, 12, 3, "MID", False, False, True, 4.0, None)]
    picks = spark.createDataFrame(
        rows, "run long, gw long, player_code long, slot int, position string, is_captain boolean,"
              " is_vice boolean, played boolean, points double, expected_points double")
    got = SQ.settle(picks, squad=("run", "gw"), xi_size=2, min_def=1, min_fwd=0).first()
    assert got.playing == [10, 12]
    assert (got.gw_total, got.predicted_points) == (10.0, 4.0)


def test_backtest_deals_members_not_weeks(spark):
    squads = spark.createDataFrame(
        [(7, 1, 10, 1, "DEF", True, False), (None, 1, 10, 1, "DEF", True, False)],
        "run long, gw long, player_code long, slot int, position string, is_captain boolean,"
        " is_vice boolean")
    actuals = spark.createDataFrame([(10, 1, 90, 2.0), (10, 3, 90, 5.0)],
                                    "player_code long, gw long, minutes int, total_points double")
    ahead = spark.createDataFrame([(10, 1, 1.5), (10, 3, None)],
                                  "player_code long, gw long, expected_points double")
    out = SQ.backtest(squads, actuals, 3, ahead, xi_size=1, min_def=0, min_fwd=0)
    got = {(r.run, r.gw): (r.actual_points, r.predicted_points) for r in out.collect()}
    assert got == {(7, 1): (4.0, 3.0), (7, 2): (0.0, 0.0), (7, 3): (10.0, 0.0),
                   (None, 1): (4.0, 0.0), (None, 2): (0.0, 0.0), (None, 3): (10.0, 0.0)}
    assert "gw#" not in _plan(out).split("Join")[1].split("\n")[0]   # joins by entity alone


def test_line_up_joins_nothing_back(spark):
    members = spark.createDataFrame(
        [("a", 1, "GKP", 1.0), ("a", 2, "DEF", 3.0), ("a", 3, "DEF", 2.0), (None, 4, "GKP", 1.0)],
        "squad string, player_code long, position string, value double")
    out = SQ.best_xi(members, formations=((1, 1, 0, 0),))
    assert "Join" not in _plan(out)
    assert {(r.player_code, r.is_starter, r.xi_score) for r in out.collect()} == {
        (1, True, 4.0), (2, True, 4.0), (3, False, 4.0)}


def test_swaps_of_sold_members_only(spark):
    members = spark.createDataFrame(
        [("a", 1, "MID", 1, 50, 1.0), ("a", 2, "MID", 2, 50, 2.0)],
        "squad string, player_code long, position string, team_code long, price_tenths long,"
        " value double")
    pool = members.drop("squad").unionByName(spark.createDataFrame(
        [(3, "MID", 3, 50, 9.0)], members.drop("squad").schema))
    sold = members.where("player_code = 1").select("squad", "player_code")
    out = SW.legal_swaps(members, pool, selling=sold)
    assert [(r.out_code, r.options[0].in_code) for r in out.collect()] == [(1, 3)]
    assert "BroadcastHashJoin" in _plan(out)


def test_club_pairs_come_from_the_squad(spark):
    members = spark.createDataFrame(
        [(1, 1, 10, 1, 1.0, 2.0), (1, 1, 11, 2, 1.0, 2.0), (1, 1, 12, 2, 1.0, 2.0),
         (2, 1, 13, None, 1.0, 2.0)],
        "squad long, gw long, player_code long, team_code long, expected double, actual double")
    variance = spark.createDataFrame([(10, 1.0)], "player_code long, sig2 double")
    matches = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 2, 9)],
                                    "gw long, home_team long, away_team long")
    structure = spark.createDataFrame([(1.0, 0.1, 0.1, 0.1)],
                                      "pooled double, alpha double, beta double, rho double")
    out = CO.squad_variance(members, variance, matches, structure)
    assert {(r.squad, r.same, r.opp) for r in out.collect()} == {(1, 1, 2), (2, 0, 0)}
    # A club never meets all its opponents of the period before those of the squad.
    assert "SortMergeJoin [gw" not in _plan(out)


def test_grid_sorts_a_vector_once(spark):
    v = [float(x) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9)]
    df = spark.createDataFrame([(v, [0.0, 2.5, 9.0])], "vector array<double>, xs array<double>")
    cdf = Q.grid_cdf("vector", "xs")
    assert str(cdf).count("sort_array") <= 1
    assert df.select(cdf.alias("c")).first().c == pytest.approx([0.0, 0.075, 1.0])


def test_model_rows_are_worked_out_once():
    from panelspark.plans import metric_queries
    assert "stored(_ml_rows(r)" in inspect.getsource(metric_queries)


def test_quantile_places(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(11)], "k long, x double")
    got = scale.exact_quantiles(df, ["k"], "x", (0.0, 0.25, 1.0)).first().quantiles
    assert got == [0.0, 2.5, 10.0]


def test_repeated_records_are_dealt_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    root, folder = str(tmp_path), str(tmp_path / "2025" / "By Gameweek")
    FILES.make_folder(spark, folder)
    rows = spark.range(600).select(
        (F.col("id") % 200).alias("player_id"), F.lit("m").alias("match_id"),
        F.col("id").cast("double").alias("goals"),
        *[F.lit(1.0).alias(c) for c in ("minutes_played", "assists", "xg", "xa")],
        (F.col("id") / 200).cast("int").alias("folder"))
    FILES.write_periods(rows, F.col("folder"), folder, "playermatchstats.csv")
    monkeypatch.setattr(scale, "ROWS_A_TASK", 20)
    got = T.load_season(spark, root, "2025", ["match_stats"])["match_stats"]
    assert got.rdd.getNumPartitions() >= 30      # not the session's 4
    assert {(r.player_id, r.gw, r.goals, r.season) for r in got.collect()} == {
        (k, 0, float(k), "2025") for k in range(200)}


def test_one_key_of_most_rows_is_kept_once_when_dealt(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_A_TASK", 10)
    hot = spark.range(400).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    df = hot.unionByName(spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    out = scale.keep_one_dealt(df, ["k"], [F.col("v").desc()], ["v"], 400)
    assert {(r.k, r.v) for r in out.collect()} == {(None, 399), *((k, 1) for k in range(20))}


def test_series_are_kept_for_boxes_not_for_squads(spark, monkeypatch):
    wide = {}

    def spy(df, name):
        out = keep(df, name)
        if len(df.columns) > H.ORDER:
            wide[name] = out.count()
        return out

    keep = H.stored
    monkeypatch.setattr(H, "stored", spy)
    df = spark.range(300).select(F.col("id").alias("team_id"), F.lit(1).alias("gw"),
                                 (F.col("id") / 100).alias("sample_mean"),
                                 F.lit(25.0).alias("sample_std"))
    assert H.expected_record(df).count() == 300
    assert wide and max(wide.values()) <= 5


PLAN_MEMBER = ("squad string, player_code long, position string, team_code long, price_tenths long,"
               " value double")


def _plan_tables(spark):
    """Two squads, and a pool whose best candidates are of a club that is full in one."""
    rows = [("a", 1, "GKP", 1, 50, 1.0), ("a", 2, "DEF", 2, 50, 2.0), ("a", 3, "DEF", 3, 50, None),
            ("a", 4, "MID", 4, 50, 3.0), ("a", 5, "MID", 4, 50, 0.0),
            ("b", 1, "GKP", 1, 50, 1.0), ("b", 4, "MID", 4, 50, 3.0), ("b", 9, "FWD", 5, 50, 4.0)]
    members = spark.createDataFrame(rows, PLAN_MEMBER)
    pool = spark.createDataFrame(
        [(100 + i, "DEF", 4, 50, 90.0 - i) for i in range(60)]
        + [(200 + i, "DEF", 8 + i, 50, 20.0 - i) for i in range(3)]
        + [(300 + i, "MID", 20 + i, 50, 5.0 + i) for i in range(30)], PLAN_MEMBER.split(", ", 1)[1])
    return members, pool


def test_a_plan_reads_a_whole_list_where_its_head_is_not_enough(spark):
    members, pool = _plan_tables(spark)
    out = SW.plan_options(members, pool, top=3, bank=0, max_per_club=2, sell_bottom_q=1.0,
                          formations=((1, 1, 1, 0),), rows=8)
    # Every list is looked at once: at its head, as a whole, and that of the member's club.
    assert _plan(out).count("arrays_overlap") <= 3
    got = {}
    for r in out.collect():
        got.setdefault(r.squad, []).append((r.rank, r.transfer_out_code, r.transfer_in_code,
                                            r.expected_score, r.expected_delta))
    # Club 4 is full in squad a, so only its own members give way to it.
    assert sorted(got["a"]) == [(1, 4, 329, 71.0, 62.0), (2, 5, 329, 71.0, 62.0),
                                (3, 4, 328, 69.0, 60.0)]
    assert "b" not in got                                   # no DEF, so no line-up


def test_line_ups_of_a_plan_are_worked_out_in_one_row(spark):
    members, pool = _plan_tables(spark)
    options = spark.createDataFrame(
        [("a", 1, None, None), ("a", 2, 2, 200), ("a", 3, 4, 310), ("b", 1, None, None),
         (None, 1, None, None), ("a", None, None, None)],
        "squad string, rank int, transfer_out_code long, transfer_in_code long")
    vectors = spark.createDataFrame(
        [(c, [float(c)] * 9) for c in (1, 2, 3, 4, 5, 200)] + [(5, [1.0] * 9), (310, [1.0])],
        "player_code long, vector array<double>")
    out = SW.plan_distributions(options, members, pool, vectors, formations=((1, 1, 1, 0),), rows=8)
    assert "Generate" not in _plan(out)                     # members don't become rows again
    got = {r["rank"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3]                         # squad b fits no formation
    line = lambda r: (r.captain, r.vice_captain, r.starters, r.bench, r.xi_q50, r.prob_beat_hold)
    assert line(got[1]) == (4, 2, [1, 2, 4], [3, 5], 11.0, 0.5)
    assert line(got[2]) == (200, 4, [1, 4, 200], [3, 5], 405.0, 1.0)
    assert line(got[3]) == (310, 2, [1, 2, 310], [3, 5], None, None)    # no whole vector


def test_a_starter_without_a_value_or_with_two_vectors_counts(spark):
    members = spark.createDataFrame(
        [("a", 1, "GKP", 1, 50, None), ("a", 2, "DEF", 1, 50, 0.0), ("a", 3, "DEF", 2, 50, -1.0)],
        PLAN_MEMBER)
    pool = members.drop("squad").limit(0)
    options = spark.createDataFrame([("a", 1, None, None)], "squad string, rank int,"
                                    " transfer_out_code long, transfer_in_code long")
    vectors = spark.createDataFrame([(1, [1.0] * 9), (2, [2.0] * 8 + [None]), (2, [5.0] * 9)],
                                    "player_code long, vector array<double>")
    r = SW.plan_distributions(options, members, pool, vectors, formations=((1, 1, 0, 0),)).first()
    assert (r.captain, r.vice_captain, r.starters, r.bench) == (2, 1, [1, 2], [3])
    assert r.xi_quantiles == [15.0] * 8 + [11.0]


def test_places_of_quantiles_are_found_by_plain_comparisons(spark):
    df = spark.createDataFrame([(k % 3, float(k * k % 11)) for k in range(40)], "k long, x double")
    out = scale.exact_quantiles(df, ["k"], "x", (0.0, 0.1, 0.5, 0.77, 1.0))
    choosing = [x for x in _plan(out).split("\n") if "Filter" in x or "Join" in x]
    assert choosing and not [x for x in choosing if "FLOOR" in x]
    for r in out.collect():
        v = sorted(float(k * k % 11) for k in range(40) if k % 3 == r.k)
        want = []
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            h = q * (len(v) - 1)
            low = int(h)
            want.append(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (h - low))
        assert r.quantiles == pytest.approx(want)


def test_a_week_plan_works_out_picks_and_vectors_once():
    from panelspark.plans import squad_queries
    assert "stored(r.picks()" in inspect.getsource(squad_queries.week_plan)
    assert '"plan-vectors")' in inspect.getsource(SW.week_plan)
