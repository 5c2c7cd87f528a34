"""Tables written as season folders and read back."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from panelspark.sources import season_files as FILES
from panelspark.sources import tree as T

HISTORY = "player_id long, gw long, team_code long"


def test_periods_become_folders_and_come_back(spark, tmp_path):
    base = str(tmp_path / "By Gameweek")
    rows = [(1, 2, 'a "b", c', None), (2, 2, None, 1.5), (3, 10, "ü", 0.0)]
    df = spark.createDataFrame(rows, "id long, gw long, name string, x double")
    assert FILES.write_periods(df, F.col("gw"), base, "t.csv") == [2, 10]
    assert sorted(os.listdir(base)) == ["GW10", "GW2"]           # nothing staged stays
    back = T.read_csv(spark, f"{base}/GW[0-9]*/t.csv")
    assert len(back) == 1
    got = {(int(r.id), int(r["__folder_gw"]), r.name, r.x and float(r.x))
           for r in back[0].collect()}
    assert got == {(1, 2, 'a "b", c', None), (2, 2, None, 1.5), (3, 10, "ü", 0.0)}
    with pytest.raises(FileExistsError):
        FILES.write_periods(df, F.col("gw"), base, "t.csv")
    FILES.write_periods(df, F.col("gw"), base, "other.csv")     # next to the first
    assert sorted(os.listdir(f"{base}/GW2")) == ["other.csv", "t.csv"]


def test_rows_without_a_period_have_no_place(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 3)], HISTORY)
    with pytest.raises(ValueError, match="without a period"):
        FILES.write_periods(df, F.col("gw"), str(tmp_path / "x"), "t.csv")


def test_no_rows_write_no_folder(spark, tmp_path):
    df = spark.createDataFrame([], HISTORY)
    base = str(tmp_path / "x")
    assert FILES.write_periods(df, F.col("gw"), base, "t.csv") == []
    assert T.read_csv(spark, f"{base}/GW[0-9]*/t.csv") == []


def test_only_named_tables_are_read(spark, tmp_path):
    season = tmp_path / "2025"
    FILES.make_folder(spark, str(season / "By Gameweek"))
    df = spark.createDataFrame([(1, 2, 3), (4, 5, None)], HISTORY)
    FILES.write_file(df, str(season / "team_history.csv"))
    got = T.load_season(spark, str(tmp_path), "2025", ["team_history", "matches"])
    assert sorted(got) == ["matches", "team_history"] and got["matches"].isEmpty()
    assert {tuple(r) for r in got["team_history"].collect()} == {
        (1, 2, 3, "2025"), (4, 5, None, "2025")}
    with pytest.raises(FileNotFoundError):
        T.load_season(spark, str(tmp_path), "2025", ["players"])
