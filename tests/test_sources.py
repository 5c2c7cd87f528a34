from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.operators import models as ML
from panelspark.operators import snapshot as SN
from panelspark.sources import artifacts as A
from panelspark.sources import documents as D
from panelspark.sources import tree as T


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


PLAYERS = ("player_code,player_id,first_name,second_name,web_name,team_code,position\n"
           "1430,430,A,B,Wilson,43.0,Forward\n1239,239,C,D,Wilson,3,Goalkeeper\n"
           "1100,100,E,F,Else,3,Unknown\n")
TEAMS = ("code,id,name,short_name,strength,strength_overall_home,pulse_id,elo,fotmob_name\n"
         "43,1,City,CTY,5,1,1,2064.0,x\n3,2,Town,TWN,,1,1,,y\n")
STATS = ("id,gw,web_name,second_name,status,total_points,minutes,goals_scored,assists,bonus,bps,"
         "saves,starts,now_cost,form,ep_next,ep_this,selected_by_percent\n")
MATCH = ("gameweek,kickoff_time,home_team,home_team_elo,home_score,away_score,away_team,"
         "away_team_elo,finished,match_id,match_url,tournament\n")


def modern(root):
    put(root, "2025/players.csv", PLAYERS)
    put(root, "2025/teams.csv", TEAMS)
    put(root, "2025/team_history.csv", "player_id,gw,team_code\n100,1,43\n")
    g = "2025/By Gameweek/GW"
    put(root, f"{g}1/player_gameweek_stats.csv", STATS
        + "430,1,W,B,a,13,90,2,1,3,50,0,1,15.5,1.0,0.0,4.5,60.1\n"
        + "239,1,W,D,i,9,90,0,0,0,10,4,1,5.5,1.0,0.0,4.5,3.0\n")
    put(root, f"{g}2/player_gameweek_stats.csv", STATS
        + "430,2,W,B,a,2,60,0,0,0,5,0,1,15.6,1.0,3.0,4.5,60.1\n"
        + "430,1,W,B,a,99,90,2,1,3,50,0,1,15.5,1.0,0.0,4.5,60.1\n")
    put(root, f"{g}10/player_gameweek_stats.csv", STATS
        + "430,3,W,B,a,4,60,0,0,0,5,0,1,15.6,1.0,3.0,4.5,60.1\n")
    put(root, f"{g}1/playermatchstats.csv",
        "player_id,match_id,minutes_played,goals,assists,xg,xa\n239,m2,0,0,0,0,0\n"
        "430,m1,90,2,1,1.1,0.2\n")
    put(root, f"{g}1/matches.csv", MATCH
        + "1.0,d,43.0,2064,,,3.0,1991,False,m1,u,prem\n2.0,d,3.0,1991,,,43.0,2064,False,m2,u,prem\n")
    put(root, f"{g}2/matches.csv", MATCH
        + "2.0,d,3.0,1991,1.0,0.0,43.0,2064,True,m2,u,prem\n"
        + "2.0,d,3.0,1991,0.0,4.0,43.0,2064,True,c9,u,cup\n")
    put(root, f"{g}3/matches.csv", "")                      # zero bytes count as missing


def test_modern_season(spark, tmp_path):
    root = str(tmp_path)
    modern(root)
    t = T.load_season(spark, root, "2025")
    assert {r.player_code: r.position for r in t["players"].collect()} == {
        1430: "FWD", 1239: "GKP", 1100: "UNK"}
    assert {f.name: f.dataType for f in t["gw_stats"].schema} == {
        **{f.name: f.dataType for f in S.GW_STATS}, "season": S.STRING}
    stats = {(r.player_id, r.gw): r for r in t["gw_stats"].collect()}
    assert len(stats) == 4
    assert stats[(430, 1)].total_points == 13               # the first folder wins
    assert stats[(430, 1)].ep_next == 4.5                   # repaired
    assert stats[(239, 1)].ep_next == 0.0                   # not available: kept
    matches = {r.match_id: r for r in t["matches"].collect()}
    assert len(matches) == 3
    assert matches["m2"].home_score == 1 and matches["m2"].finished     # the last one wins
    assert matches["m1"].home_score is None and matches["m1"].home_team == 43
    assert {r.tournament for r in matches.values()} == {"prem", "cup"}
    assert {(r.player_id, r.minutes_played, r.gw) for r in t["match_stats"].collect()} == {
        (239, 0.0, 1), (430, 90.0, 1)}
    assert t["team_history"].count() == 1
    assert {r.code: r.elo for r in t["teams"].collect()} == {43: 2064.0, 3: None}


def test_unknown_position_stops(spark, tmp_path):
    put(str(tmp_path), "p.csv", PLAYERS.replace("Forward", "Libero"))
    raw = T.read_csv(spark, str(tmp_path / "p.csv"))[0]
    with pytest.raises(Exception, match="unknown position word: Libero"):
        T.players_from(raw).collect()


def test_legacy_season_and_store(spark, tmp_path):
    root, out = str(tmp_path / "raw"), str(tmp_path / "out")
    modern(root)
    put(root, "2024/players/players.csv", PLAYERS)
    put(root, "2024/teams/teams.csv", TEAMS)
    put(root, "2024/playerstats/playerstats.csv",
        "id,gw,status,total_points,event_points,bonus,bps,now_cost,form,ep_next,ep_this,"
        "selected_by_percent\n430,1,a,13,13,1,2,15.0,1,2,3,4\n430,2,a,15,2,1,2,15.0,1,2,3,4\n"
        "430,3,a,16,1,1,2,15.0,1,2,3,4\n")
    put(root, "2024/matches/GW1/matches.csv", MATCH.replace(",tournament", "")
        + "1.0,d,43.0,2064,1,1,3.0,1991,True,o1,u\n")
    t = T.load_season(spark, root, "2024")
    stats = {r.gw: r for r in t["gw_stats"].collect()}
    assert [stats[g].total_points for g in (1, 2, 3)] == [13, 2, 1]
    assert stats[1].minutes is None and stats[1].web_name is None
    assert t["matches"].first().tournament == "prem"
    assert t["team_history"].count() == 0 and t["match_stats"].count() == 0
    assert t["gw_stats"].schema == T.load_season(spark, root, "2025")["gw_stats"].schema
    with pytest.raises(ValueError):
        T.detect_layout(str(tmp_path))

    T.ingest(spark, root, ["2024", "2025"], out)
    T.ingest(spark, root, ["2025"], out)                    # a rerun replaces its season only
    assert T.read_table(spark, out, "gw_stats").count() == 7
    plan = T.read_table(spark, out, "gw_stats", ["2024"])
    assert plan.count() == 3
    T.write_features(spark, out, ["2024", "2025"])
    late = T.read_table(spark, out, "features", ["2025"])
    # the first period of the new season is seeded from the old one
    assert {(r.player_id, r.gw): r.prev_points for r in late.collect()}[(430, 1)] == 2.0
    rows = T.load_training(spark, out, ["2024", "2025"])
    assert {r.season for r in rows.select("season").distinct().collect()} == {"2024", "2025"}
    assert rows.where("next_points is null").count() == 0
    with pytest.raises(SN.FreshnessError):
        SN.check_has_rows(late.where("gw > 99"), "features")


ELEMENTS = [
    {"id": 1, "code": 11, "web_name": "A", "team": 1, "team_code": 43, "element_type": 1,
     "now_cost": 155, "status": "a", "news": "", "chance_of_playing_next_round": None,
     "selected_by_percent": "3.4", "minutes": 90, "ep_next": "3.0", "removed": False,
     "can_select": True, "can_transact": True},
    {"id": 2, "code": 12, "web_name": "B", "team": 2, "team_code": 3, "element_type": 4,
     "now_cost": 60, "status": "d", "news": " hurt ", "chance_of_playing_next_round": 50,
     "selected_by_percent": "x", "minutes": 0, "ep_next": None, "removed": False,
     "can_select": True, "can_transact": True}]


def test_snapshot_documents(spark, tmp_path):
    root = str(tmp_path)
    doc = {"payload": {"elements": ELEMENTS, "teams": [
        {"code": 43, "id": 1, "name": "City", "short_name": "CTY"},
        {"code": 3, "id": 2, "name": "Town", "short_name": None}], "events": []},
        "fetched_at": "2025-01-01", "fetched_epoch": 1000.5}
    put(root, "live.json", json.dumps(doc))
    snap = D.read_snapshot(spark, os.path.join(root, "live.json"))
    live = D.live_frame(snap)
    assert tuple(live.columns) == D.LIVE_COLUMNS and live.count() == 2
    assert {r.team_code: r.team for r in SN.team_names(D.live_teams(snap)).collect()} == {
        43: "CTY", 3: "Town"}
    put(root, "cut.json", json.dumps(doc)[:200])
    assert D.read_snapshot(spark, os.path.join(root, "cut.json")).count() == 0
    put(root, "part.json", json.dumps({"payload": doc["payload"]}))
    assert D.read_snapshot(spark, os.path.join(root, "part.json")).count() == 0
    assert D.read_snapshot(spark, os.path.join(root, "none.json")) is None
    SN.check_snapshot_age(1000.5, 3600, now=2000)
    with pytest.raises(SN.FreshnessError):
        SN.check_snapshot_age(1000.5, 60, now=2000)


def test_league_documents(spark, tmp_path):
    root = str(tmp_path)
    put(root, "entry_5_history.json", json.dumps(
        {"current": [{"event": 1, "points": 50, "total_points": 50, "rank": 9,
                      "points_on_bench": 3, "event_transfers": 1}], "past": []}))
    put(root, "entry_5_gw1_picks.json", json.dumps(
        {"picks": [{"element": 9, "position": 1, "multiplier": 2, "is_captain": True,
                    "is_vice_captain": False, "element_type": 3}]}))
    put(root, "gw1_live.json", json.dumps(
        {"elements": [{"id": 9, "stats": {"minutes": 90, "total_points": 7}}]}))
    for n, results in ((1, [{"entry": 5, "rank": 1, "total": 50, "entry_name": "T"}]),
                       (2, [{"entry": None, "rank": 2}])):
        put(root, f"standings_page{n}.json", json.dumps({"standings": {"results": results}}))
    put(root, "h2h.json", json.dumps({"results": [
        {"event": 1, "entry_1_entry": 5, "entry_1_points": 50, "entry_2_entry": 6,
         "entry_2_points": 40, "is_bye": False}]}))
    put(root, "me.json", json.dumps({"entry": {"id": 5}}))
    put(root, "me2.json", json.dumps({"entry_id": 6, "entry": {"id": 5}}))
    at = lambda n: os.path.join(root, n)
    h = D.read_history(spark, at("entry_*_history.json")).first()
    assert (h.entry_id, h.event, h.points) == (5, 1, 50)
    p = D.read_picks(spark, at("entry_*_picks.json")).first()
    assert (p.entry_id, p.gw, p.element, p.is_captain) == (5, 1, 9, True)
    e = D.read_event_live(spark, at("gw*_live.json")).first()
    assert (e.gw, e.player_id, e.minutes, e.total_points) == (1, 9, 90, 7)
    s = D.read_standings(spark, at("standings_page*.json"), 77).collect()
    assert [(r.league_id, r.entry_id, r.total) for r in s] == [(77, 5, 50)]
    assert D.read_matches(spark, at("h2h.json")).first().entry_2_points == 40
    assert D.read_entry(spark, at("me.json")).first().entry_id == 5
    assert D.read_entry(spark, at("me2.json")).first().entry_id == 6
    A.write_collected({"history": D.read_history(spark, at("entry_*_history.json"))}, at("col"))
    assert spark.read.parquet(at("col/history")).count() == 1


def test_newest_plan_by_number(spark, tmp_path):
    for n, gain in ((5, 1.0), (12, 2.5)):
        put(str(tmp_path), f"gw{n}_plan.json", json.dumps(
            {"gw": n + 1, "bank_tenths": 3, "sell_bottom_q": 0.4, "options": [
                {"transfer_in_code": 1, "transfer_out_code": 2, "expected_delta": gain},
                {"transfer_in_code": None, "expected_delta": 0.0}]}))
    plans = D.read_json(spark, str(tmp_path / "gw*_plan.json"), D.PLAN)
    got = D.suggestions(plans).orderBy("place").collect()
    assert [(r.gw, r.sell_bottom_pct, r.expected_gain) for r in got] == [
        (13, 40, 2.5), (13, 40, 0.0)]
    assert [r.file for r in D.in_name_order(plans).collect()] == ["gw5_plan.json",
                                                                 "gw12_plan.json"]


def test_forecast_window_and_candidates(spark, tmp_path):
    path = str(tmp_path / "fc")
    fc = spark.createDataFrame(
        [(1, "A", "DEF", 3, 2.0, [-1.0, *map(float, range(8))]),
         (2, "B", "MID", 3, 2.5, [float(i) for i in range(9)])],
        "player_code long, web_name string, position string, gw long, pred double, "
        "vector array<double>")
    A.write_forecast(fc, path, "2025", 3, 4)
    A.write_forecast(fc.where("player_code = 1"), path, "2025", 5, 5)
    got = A.read_forecast(spark, path, "2025", 3, 4, codes=[1]).first()
    assert got.q1 == 0.0 and got.q99 == 7.0
    assert A.read_forecast(spark, path, "2025", 3, 4, position="MID").count() == 1
    assert A.read_forecast(spark, path, "2025", 5, 5).count() == 1
    with pytest.raises(ValueError):
        A.read_forecast(spark, path, "2025", 1, 12)
    basket = spark.createDataFrame([(1, 9, "DEF", 50, 4.0)],
                                   "team_id long, player_code long, position string, "
                                   "price_tenths long, expected_total double")
    ranks = spark.createDataFrame([(1, 0)], "team_id long, candidate_rank int")
    A.ranked_candidates(basket, ranks, season="2025", gw_start=1, gw_end=3)
    with pytest.raises(ValueError, match="position"):
        A.validate_candidates(basket.drop("position"))


def test_compare_results(spark, tmp_path):
    put(str(tmp_path), "r.json", json.dumps({"results": [
        {"name": "x", "metrics": [{"cohort": "all", "mae": 1.5, "n": 9},
                                  {"cohort": "top10", "mae": 2.5, "n": 1}],
         "ranking": {"spearman_rho": 0.5, "n": 9}, "calibration": {"ece": 0.1},
         "gym": {"runs": [{"totals": {"settlement": "actual", "total_actual": 70.0}}]}},
        {"name": "y", "metrics": [{"cohort": "all", "mae": 1.0, "n": 9}]}]}))
    wide = {r["name"]: r for r in A.compare_results(
        A.result_documents(spark, str(tmp_path / "r.json"))).collect()}
    assert wide["x"]["mae@all"] == 1.5 and wide["x"]["mae@top10"] == 2.5
    assert wide["x"]["rank@spearman_rho"] == 0.5 and wide["x"]["gym@total_actual"] == 70.0
    assert wide["y"]["mae@all"] == 1.0 and wide["y"]["cal@ece"] is None
    A.write_json(spark.range(2), str(tmp_path / "j"))
    A.write_csv(spark.range(2), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_drift_gate(spark):
    live = spark.createDataFrame(
        [(c, f"p{c}", 50 + (c < 3), 1, "a" if c else "i", None) for c in range(8)],
        "player_code long, web_name string, now_cost long, team_code long, status string, "
        "news string")
    data = spark.createDataFrame([(c, 5.0, 1) for c in range(8)],
                                 "player_code long, now_cost double, team_code long")
    with pytest.raises(SN.FreshnessError, match="price_moved 0.375.*not_available 0.125"):
        SN.check_drift(live, data)
    SN.check_drift(live, data, price_moved=0.5, not_available=0.2)
    SN.check_drift(live, data.where("player_code > 99"))     # no overlap: no verdict


def model_frame(spark):
    import random
    rng = random.Random(1)
    rows = []
    for season in ("a", "b"):
        for i in range(40):
            skill = rng.uniform(0, 6)
            for g in range(1, 9):
                rows.append((season, i, 1000 + i, g, rng.choice(["DEF", "MID"]), skill,
                             None if g == 3 else skill * 2,
                             round(skill + rng.gauss(0, 0.5), 2)))
    return spark.createDataFrame(
        rows, "season string, player_id long, player_code long, gw long, position string, "
              "f1 double, f2 double, next_points double")


def test_models(spark, tmp_path):
    rows, features = model_frame(spark), ("f1", "f2")
    split = {"fit_gw_max": 5, "cal_start": 6, "cal_end": 5, "test_start": 6}
    for kind, params in (("trees", {"rounds": 5, "depth": 3}), ("ridge", {"reg": 0.01})):
        out = ML.run_experiment(rows, {"name": kind, "model": kind, "features": features,
                                       "params": params, "split": split, "seasons": ["a", "b"]})
        whole = out["metrics"].where("cohort = 'all'").first()
        assert whole.n == 40 * 3 and whole.mae < 1.0 and whole["name"] == kind
        assert out["ranking"].first().spearman_rho > 0.8
        assert 0.5 < out["calibration"].first().slope < 1.5
    train = rows.where("gw <= 5")
    model = ML.fit(train, "trees", features, rounds=3, depth=2)
    path = str(tmp_path / "model")
    ML.save(model, path)
    a = ML.predict(model, rows, features).orderBy("season", "player_id", "gw")
    b = ML.predict(ML.load(path), rows, features).orderBy("season", "player_id", "gw")
    assert a.collect() == b.collect()
    top = ML.importances(model, features, 1).collect()
    assert len(top) == 1 and top[0].importance > 0.4
    held = ML.predict(model, rows.where("gw > 5"), features)
    sigma = ML.fit_sigma(held, features, rounds=2, depth=2)
    assert ML.predict(sigma, held.drop("pred"), features, name="sigma").where(
        "sigma is null").count() == 0
    parts = ML.fit_by_position(train, ["DEF", "MID"], features, rounds=2, depth=2)
    assert ML.predict_by_position(parts, rows, features).count() == rows.count()
    sens = ML.rounds_sensitivity(train, rows.where("gw > 5"), (1, 4), features, depth=2)
    assert [r.rounds for r in sens.orderBy("rounds").collect()] == [1, 4]
    people = rows.select("player_id", "player_code").distinct().select(
        "*", F.lit("n").alias("web_name"), F.lit("DEF").alias("position"),
        F.lit(1).alias("team_code"))
    ahead = ML.horizon_forecast(model, rows.where("season = 'b'"), people, 4, 5, features)
    assert {r.gw for r in ahead.select("gw").distinct().collect()} == {4, 5}
    with pytest.raises(ValueError, match="no feature rows"):
        ML.horizon_forecast(model, rows, people, 40, 41, features)


def test_mixed_headers_and_empty_files(spark, tmp_path):
    """Columns go by each file's header; files without bytes are skipped one by one."""
    root, out = str(tmp_path / "raw"), str(tmp_path / "out")
    modern(root)
    line = MATCH.splitlines()[0].split(",")
    swapped = [c for c in reversed(line) if c != "tournament"]
    values = dict(zip(line, [""] * len(line), strict=True)) | {
        "gameweek": "9.0", "home_team": "3", "away_team": "43.0", "match_id": "m9",
        "finished": "True", "home_score": "2", "away_score": "0"}
    put(root, "2025/By Gameweek/GW9/matches.csv",
        ",".join(swapped) + "\n" + ",".join(values[c] for c in swapped) + "\n")
    put(root, "2025/By Gameweek/GW8/matches.csv", "")
    got = {r.match_id: r for r in T.load_season(spark, root, "2025")["matches"].collect()}
    assert (got["m9"].home_team, got["m9"].away_team, got["m9"].gw, got["m9"].tournament,
            got["m9"].home_score) == (3, 43, 9, "prem", 2)
    assert "cup" in {r.tournament for r in got.values()}
    T.ingest(spark, root, ["2025"], out)
    tables = T.load_season(spark, root, "2025")
    T.write_tables({"matches": tables["matches"].limit(0)}, out, "2025")
    assert T.read_table(spark, out, "matches").count() == 0    # an emptied rerun leaves nothing
    assert T.read_table(spark, out, "players", ["2025"]).count() > 0


def test_position_query_has_all_positions_and_whole_models(spark, monkeypatch):
    from panelspark.plans import all_queries, metric_queries
    from panelspark.plans.bindings import Roles

    trees, asked = ML.tree_pipeline, []

    def short(features, label, **params):
        asked.append(params)
        return trees(features, label, rounds=1, depth=1)

    monkeypatch.setitem(ML.REGISTRY, "trees", short)
    sf = "/root/testdata/sf0.001"
    rows = metric_queries._ml_rows(Roles(spark, sf)).where("gw > 18")
    want = {r["position"]: r["count"] for r in rows.groupBy("position").count().collect()}
    got = all_queries()["sigma_and_positions"](spark, sf).collect()
    assert {r.position: r.n for r in got} == want and len(want) > 2
    all_queries()["gbt_forecast"](spark, sf)
    assert asked and not any(asked)  # the operator's own rounds and depth


def test_rows_of_a_position_without_a_model_stay(spark):
    rows = spark.createDataFrame([(p, float(i), 2.0 * i, 7.0) for i in range(8) for p in (
        "DEF", "GKP", None)], "position string, x double, next_points double, pred_global double")
    models = ML.fit_by_position(rows.where("position = 'DEF'"), features=["x"], rounds=1, depth=1)
    out = ML.predict_by_position(models, rows, ["x"], other="pred_global")
    assert list(models) == ["DEF"] and out.count() == rows.count()
    assert out.where("position is null or position = 'GKP'").where("pred_position <> 7").count() == 0
