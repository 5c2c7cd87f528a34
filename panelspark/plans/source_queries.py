"""Source queries: the role tables as season folders of CSV files, ingested and read back.

Season 2024 has the older layout and the periods up to 15, season 2025 the newer one and
the later periods. The files hold what the readers have to mend: columns in another order
from one period to the next, records that come again in a later folder, postponed matches,
forecasts to repair, running totals, absent columns and empty files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import scalar as X
from panelspark.plans.bindings import money
from panelspark.plans.registry import query, rounded
from panelspark.plans.roles_sql import r6
from panelspark.session import use_checkpoint_dir
from panelspark.sources import season_files as FILES
from panelspark.sources import tree as T

OLD, NEW = "2024", "2025"
LAST_OLD = 15           # periods up to this one are the older season
WORDS = {code: word for word, code in S.POSITION_WORDS.items()}


class Tree:
    """Both seasons below a folder of their own in the shared folder."""

    def __init__(self, r) -> None:
        base = use_checkpoint_dir(r.spark)
        if base is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        self.r, self.spark = r, r.spark
        self.root = f"{base.rstrip('/')}/season-files-{uuid.uuid4().hex}"
        for folder in (f"{NEW}/By Gameweek", f"{OLD}/players", f"{OLD}/matches"):
            FILES.make_folder(self.spark, f"{self.root}/{folder}")

    def whole(self, df: DataFrame, new: str, old: str | None = None) -> None:
        FILES.write_file(df, f"{self.root}/{NEW}/{new}")
        if old:
            FILES.write_file(df, f"{self.root}/{OLD}/{old}")

    def periods(self, df: DataFrame, period, folder: str, name: str) -> None:
        FILES.write_periods(df, period, f"{self.root}/{folder}", name)

    def by_header(self, df: DataFrame, folder: str, name: str) -> None:
        """Even periods as they are, odd ones with the columns turned round and one more."""
        even = F.col("folder") % 2 == 0
        columns = [c for c in df.columns if c != "folder"]
        self.periods(df.where(even).select(*columns, "folder"), F.col("folder"), folder, name)
        self.periods(df.where(~even).select(F.lit("x").alias("extra"), *columns[::-1], "folder"),
                     F.col("folder"), folder, name)

    def ingested(self, *tables: str) -> str:
        """The named tables of both seasons as parquet; the newer season twice, as in a rerun."""
        out = f"{self.root}/processed"
        for season in (OLD, NEW, NEW):
            T.write_tables(T.load_season(self.spark, self.root, season, tables), out, season)
        return out

    def read(self, table: str) -> DataFrame:
        return T.read_table(self.spark, self.ingested(table), table, [OLD, NEW])

    # -- files -----------------------------------------------------------------------

    def put_players(self) -> None:
        rows = self.r.players().select(
            "player_code", "player_id", "first_name", "second_name", "web_name",
            F.concat(F.col("team_code"), F.lit(".0")).alias("team_code"),
            X.lookup("position", WORDS).alias("position"))
        self.whole(rows, "players.csv", "players/players.csv")

    def put_team_history(self) -> None:
        self.whole(self.r.team_history().where(F.col("gw") > LAST_OLD), "team_history.csv")

    def put_stats(self) -> None:
        gw, player = F.col("gw"), F.col("player_id")
        panel = self.r.panel().select(
            player.alias("id"), "gw", F.concat(F.lit("E "), player).alias("web_name"),
            F.when(player % 4 == 0, 'say "x", y').alias("second_name"),
            F.when(player % 3 == 0, "i").otherwise("a").alias("status"),
            F.floor("total_points").alias("total_points"), "minutes",
            *[F.lit(0).alias(c) for c in ("goals_scored", "assists", "bonus", "bps", "saves")],
            "starts", "now_cost", F.lit(None).cast("double").alias("form"),
            F.when((player + gw) % 2 == 0, 0.0).otherwise(1.5).alias("ep_next"),
            (gw / 2).alias("ep_this"), F.lit(1.0).alias("selected_by_percent"))
        late = panel.where(gw > LAST_OLD)
        again = late.where("id % 5 = 0").withColumn("total_points", F.col("total_points") + 1)
        self.by_header(late.withColumn("folder", gw).unionByName(
            again.withColumn("folder", gw + 1)),
            f"{NEW}/By Gameweek", "player_gameweek_stats.csv")
        old = panel.where(gw <= LAST_OLD).select(
            "id", "gw", "status", (F.col("total_points") + 1000).alias("total_points"),
            F.col("total_points").alias("event_points"), "bonus", "bps", "now_cost", "form",
            "ep_next", "ep_this", "selected_by_percent")
        FILES.write_file(old, f"{self.root}/{OLD}/playerstats/playerstats.csv")

    def put_matches(self) -> None:
        gw, postponed = F.col("gameweek"), F.col("match_id") % 5 == 0
        rows = self.r.matches().select(
            F.col("gw").alias("gameweek"), F.lit("d").alias("kickoff_time"),
            F.concat("home_team", F.lit(".0")).alias("home_team"), "home_team_elo",
            "home_score", "away_score", F.concat("away_team", F.lit(".0")).alias("away_team"),
            "away_team_elo", "finished", "match_id", "tournament")
        unplayed = rows.where(postponed).withColumns({
            "home_score": F.lit(None).cast("long"), "away_score": F.lit(None).cast("long"),
            "finished": F.lit(False)}).withColumn("folder", gw)
        all_rows = unplayed.unionByName(
            rows.withColumn("folder", gw + F.when(postponed, 1).otherwise(0)))
        new = gw > LAST_OLD
        self.by_header(all_rows.where(new), f"{NEW}/By Gameweek", "matches.csv")
        self.periods(all_rows.where(~new).drop("tournament"), F.col("folder"),
                     f"{OLD}/matches", "matches.csv")

    def put_match_stats(self) -> None:
        rows = self.r.lines().select(
            F.col("l_partkey").alias("player_id"), F.col("l_orderkey").alias("match_id"),
            F.dayofmonth("o_orderdate").cast("long").alias("folder"),
            F.when(F.col("l_returnflag") == "A", 0).otherwise(money("l_quantity"))
            .alias("minutes_played"), "l_linenumber")
        one = rows.groupBy("player_id", "match_id", "folder").agg(
            F.sum("minutes_played").alias("minutes_played"),
            F.count(F.lit(1)).alias("goals"), F.min("l_linenumber").alias("assists"))
        one = one.withColumns({"xg": F.col("goals") / 4, "xa": F.lit(None).cast("double")})
        self.by_header(one.where(F.col("folder") > LAST_OLD), f"{NEW}/By Gameweek",
                       "playermatchstats.csv")
        self.periods(one.where(F.col("folder") <= LAST_OLD), F.col("folder"),
                     f"{OLD}/playermatchstats", "playermatchstats.csv")


@query("""
    SELECT season, player_code, player_id, first_name, second_name, web_name, team_code,
           position FROM players, (VALUES ('2024'), ('2025')) t(season)""")
def season_players(r):
    tree = Tree(r)
    tree.put_players()
    return tree.read("players")


@query("""
    SELECT season, code, code + 1 AS id, name, short_name,
           CAST(CASE WHEN code % 3 > 0 THEN code % 5 + 0.5 END AS DOUBLE) AS strength,
           CAST(CASE WHEN code % 4 > 0 THEN 1500.25 + code END AS DOUBLE) AS elo
    FROM teams, (VALUES ('2024'), ('2025')) t(season)""")
def season_teams(r):
    tree, code = Tree(r), F.col("code")
    tree.whole(r.teams().select(
        code, (code + 1).alias("id"), "name", "short_name",
        F.when(code % 3 > 0, code % 5 + 0.5).alias("strength"), F.lit(7).alias("pulse_id"),
        F.when(code % 4 > 0, F.lit(1500.25) + code).alias("elo")), "teams.csv", "teams/teams.csv")
    return tree.read("teams")


@query("""
    SELECT CASE WHEN gw <= 15 THEN '2024' ELSE '2025' END AS season, player_id, gw,
           CASE WHEN gw > 15 THEN 'E ' || player_id END AS web_name,
           CASE WHEN gw > 15 AND player_id % 4 = 0 THEN 'say "x", y' END AS second_name,
           CASE WHEN player_id % 3 = 0 THEN 'i' ELSE 'a' END AS status,
           CAST(floor(total_points) AS BIGINT) AS total_points,
           CASE WHEN gw > 15 THEN minutes END AS minutes,
           CASE WHEN gw > 15 THEN starts END AS starts, now_cost,
           CASE WHEN (player_id + gw) % 2 > 0 THEN 1.5
                WHEN gw > 15 AND player_id % 3 > 0 THEN gw / 2 ELSE 0 END AS ep_next
    FROM panel""")
def season_stats(r):
    tree = Tree(r)
    tree.put_stats()
    return tree.read("gw_stats").select(
        "season", "player_id", "gw", "web_name", "second_name", "status", "total_points",
        "minutes", "starts", "now_cost", "ep_next")


@query("""
    SELECT CASE WHEN day(o_orderdate) <= 15 THEN '2024' ELSE '2025' END AS season,
           l_partkey AS player_id, CAST(l_orderkey AS VARCHAR) AS match_id,
           CAST(day(o_orderdate) AS BIGINT) AS gw,
           CAST(sum(CASE WHEN l_returnflag = 'A' THEN 0
                         ELSE CAST(l_quantity AS DECIMAL(18, 2)) END) AS DOUBLE)
           AS minutes_played,
           CAST(count(*) AS DOUBLE) AS goals, CAST(min(l_linenumber) AS DOUBLE) AS assists,
           count(*) / 4 AS xg, CAST(NULL AS DOUBLE) AS xa
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""")
def season_match_stats(r):
    tree = Tree(r)
    tree.put_match_stats()
    return tree.read("match_stats")


@query("""
    SELECT CASE WHEN gw <= 15 THEN '2024' ELSE '2025' END AS season,
           CAST(match_id AS VARCHAR) AS match_id, gw, home_team, away_team, home_score,
           away_score, home_team_elo, away_team_elo,
           CASE WHEN gw <= 15 THEN 'prem' ELSE tournament END AS tournament, finished
    FROM matches""")
def season_matches(r):
    tree = Tree(r)
    tree.put_matches()
    return tree.read("matches").drop("kickoff_time")


@query("SELECT '2025' AS season, * FROM team_history WHERE gw > 15")
def season_team_history(r):
    """The older layout has no such file: its season is an empty table."""
    tree = Tree(r)
    tree.put_team_history()
    return tree.read("team_history")


@query(f"""
    WITH base AS (
        SELECT p.player_id, player_code, gw, gw <= 15 AS early,
               CAST(floor(total_points) AS BIGINT) AS points,
               lag(floor(total_points)) OVER w AS p1,
               avg(floor(total_points)) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3,
               avg(floor(total_points)) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5,
               lead(floor(total_points)) OVER w AS next_points
        FROM panel p JOIN players pl ON pl.player_id = p.player_id
        WINDOW w AS (PARTITION BY p.player_id, gw <= 15 ORDER BY gw)),
    seed AS (SELECT player_code, p1 AS s1, a3 AS s3, a5 AS s5 FROM (
        SELECT *, row_number() OVER (PARTITION BY player_code ORDER BY gw DESC) AS rn
        FROM base WHERE early AND p1 IS NOT NULL) WHERE rn = 1),
    seeded AS (
        SELECT b.*, s1, s3, s5, NOT early AND gw = (SELECT min(gw) FROM base WHERE NOT early)
               AS is_first
        FROM base b LEFT JOIN seed USING (player_code)),
    filled AS (
        SELECT CASE WHEN early THEN '2024' ELSE '2025' END AS season, player_code, gw,
               CAST(CASE WHEN is_first THEN coalesce(p1, s1) ELSE p1 END AS DOUBLE)
               AS prev_points,
               CASE WHEN is_first THEN coalesce(a3, s3) ELSE a3 END AS f3,
               CASE WHEN is_first THEN coalesce(a5, s5) ELSE a5 END AS f5,
               CAST(next_points AS DOUBLE) AS next_points
        FROM seeded)
    SELECT season, player_code, gw, prev_points, {r6("f3")} AS pts_avg_3,
           {r6("f5")} AS pts_avg_5, next_points
    FROM filled WHERE prev_points IS NOT NULL AND f3 IS NOT NULL AND f5 IS NOT NULL
      AND next_points IS NOT NULL""")
def season_training(r):
    """Files to stored tables to features, the older season seeding the newer, to model rows."""
    tree = Tree(r)
    for put in (tree.put_players, tree.put_team_history, tree.put_stats, tree.put_matches):
        put()
    out = tree.ingested("players", "gw_stats", "matches", "team_history")
    T.write_features(r.spark, out, [OLD, NEW])
    rows = T.load_training(r.spark, out, [OLD, NEW]).select(
        "season", "player_code", "gw", F.col("prev_points").cast("double").alias("prev_points"),
        "pts_avg_3", "pts_avg_5", F.col("next_points").cast("double").alias("next_points"))
    return rounded(rows, "pts_avg_3", "pts_avg_5")
