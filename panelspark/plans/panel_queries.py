"""Panel, feature, split and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import checks as C
from panelspark.operators import league as L
from panelspark.operators import panel as P
from panelspark.operators import pool as PL
from panelspark.operators import scale
from panelspark.operators import snapshot as SN
from panelspark.plans.registry import query, rounded
from panelspark.plans.roles_sql import r6

WINDOW = "WINDOW w AS (PARTITION BY player_id ORDER BY gw)"


@query(f"""
    SELECT player_id, gw, total_points, lag(total_points) OVER w AS prev_points,
           {r6("avg(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")}
           AS pts_avg_3,
           {r6("avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")}
           AS pts_avg_5,
           lead(total_points) OVER w AS next_points
    FROM panel {WINDOW}""")
def panel_rolling(r):
    out = P.trailing_features(r.panel().select("player_id", "gw", "total_points"))
    return rounded(out, "pts_avg_3", "pts_avg_5")


@query("""
    SELECT count(*) AS n FROM (
        SELECT next_points, lead(total_points) OVER (PARTITION BY player_id ORDER BY gw) AS e
        FROM (SELECT player_id, gw, total_points, next_points
                     + CASE WHEN gw % 7 = 0 THEN 1 ELSE 0 END AS next_points FROM form))
    WHERE e IS NOT NULL AND next_points <> e""")
def panel_target_audit(r):
    spoiled = r.form().withColumn("next_points", F.col("next_points") + F.when(
        F.col("gw") % 7 == 0, 1).otherwise(0))
    return P.target_shift_violations(spoiled)


@query(f"""
    SELECT player_id, gw,
           {r6("sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER w / 5.0")} AS appear_rate_5,
           {r6("sum(CASE WHEN starts > 0 THEN 1 ELSE 0 END) OVER w / 5.0")} AS start_rate_5,
           {r6("sum(least(CAST(minutes AS DOUBLE), 90.0)) OVER w / 450.0")} AS minutes_share_5
    FROM panel
    WINDOW w AS (PARTITION BY player_id ORDER BY gw ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def role_rates(r):
    return rounded(P.role_rates(r.panel()), "appear_rate_5", "start_rate_5", "minutes_share_5")


@query("SELECT * FROM fixtures")
def home_away_context(r):
    return P.fixture_context(r.matches())


@query(f"""
    SELECT player_id, player_code, gw, team_code, opponent_team_code, was_home, home_elo,
           opponent_elo, prev_points, {r6("pts_avg_3")} AS pts_avg_3,
           {r6("pts_avg_5")} AS pts_avg_5, total_points, next_points FROM features""")
def feature_store(r):
    return rounded(r.features(), "pts_avg_3", "pts_avg_5")


@query(f"""
    WITH base AS (
        SELECT p.player_id, player_code, gw, gw <= 15 AS early, total_points,
               lag(total_points) OVER w AS prev_points,
               avg(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3,
               avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5
        FROM panel p JOIN players pl ON pl.player_id = p.player_id
        WINDOW w AS (PARTITION BY p.player_id, gw <= 15 ORDER BY gw)),
    seed AS (SELECT player_code, prev_points AS sp, a3 AS s3, a5 AS s5 FROM (
        SELECT *, row_number() OVER (PARTITION BY player_code ORDER BY gw DESC, player_id DESC)
               AS rn FROM base WHERE early AND prev_points IS NOT NULL) WHERE rn = 1),
    late AS (SELECT b.*, sp, s3, s5, gw = (SELECT min(gw) FROM base WHERE NOT early) AS is_first
             FROM base b LEFT JOIN seed USING (player_code) WHERE NOT early)
    SELECT player_code, gw,
           {r6("CASE WHEN is_first THEN coalesce(prev_points, sp) ELSE prev_points END")}
           AS prev_points,
           {r6("CASE WHEN is_first THEN coalesce(a3, s3) ELSE a3 END")} AS pts_avg_3,
           {r6("CASE WHEN is_first THEN coalesce(a5, s5) ELSE a5 END")} AS pts_avg_5
    FROM late
    WHERE CASE WHEN is_first THEN coalesce(prev_points, sp) ELSE prev_points END IS NOT NULL
      AND CASE WHEN is_first THEN coalesce(a3, s3) ELSE a3 END IS NOT NULL""")
def features_carryover(r):
    """The first half of the month is the previous season of the second half."""
    panel, players = r.panel(), r.players()
    history = r.team_history()
    build = lambda part, carry=None: P.build_features(part, history, r.matches(), players, carry)
    seed = P.carryover_seed(build(panel.where(F.col("gw") <= 15)))
    out = build(panel.where(F.col("gw") > 15), seed).select(
        "player_code", "gw", "prev_points", "pts_avg_3", "pts_avg_5")
    return rounded(out, "prev_points", "pts_avg_3", "pts_avg_5")


@query(f"""
    SELECT player_code, {r6("pts_avg_3")} AS pts_avg_3, {r6("pts_avg_5")} AS pts_avg_5,
           prev_points
    FROM (SELECT *, row_number() OVER (PARTITION BY player_code ORDER BY gw DESC,
                                       player_id DESC) AS rn FROM form) WHERE rn = 1""")
def carryover_seed(r):
    return rounded(P.carryover_seed(r.form()), "pts_avg_3", "pts_avg_5")


@query(f"""
    SELECT f.player_id, f.player_code, f.gw, pl.position, opponent_team_code IS NOT NULL
           AS had_match,
           CASE WHEN opponent_team_code IS NOT NULL THEN was_home ELSE FALSE END AS was_home,
           {r6("coalesce(home_elo, 0.0)")} AS home_elo,
           {r6("coalesce(opponent_elo, 0.0)")} AS opponent_elo,
           coalesce(p.now_cost, 0.0) AS now_cost, coalesce(p.starts * 1.5::DOUBLE, 0.0) AS ep_next,
           CASE pl.position WHEN 'DEF' THEN 0 WHEN 'FWD' THEN 1 WHEN 'GKP' THEN 2
                WHEN 'MID' THEN 3 END AS position_code, next_points
    FROM features f LEFT JOIN players pl USING (player_code)
    LEFT JOIN panel p ON p.player_id = f.player_id AND p.gw = f.gw
    WHERE next_points IS NOT NULL""")
def model_rows(r):
    stats = r.panel().withColumn("ep_next", F.col("starts") * F.lit(1.5))
    out = P.model_rows(r.features(), r.players(), stats).select(
        "player_id", "player_code", "gw", "position", "had_match", "was_home", "home_elo",
        "opponent_elo", "now_cost", "ep_next", "position_code", "next_points")
    return rounded(out, "home_elo", "opponent_elo")


def _copies(r):
    """Lines as repeated records of (order, line number), in a stated order."""
    return r.t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("l_quantity"), F.col("l_extendedprice"))


_DEDUPE = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate {d}, l_partkey {d}, l_suppkey {d}, l_quantity {d},
                     l_extendedprice {d}) AS rn FROM lineitem) WHERE rn = 1"""
_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(_DEDUPE.format(d="ASC"))
def dedupe_first(r):
    return P.union_keep([_copies(r)], ["l_orderkey", "l_linenumber"], _ORDER, "first").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(_DEDUPE.format(d="DESC"))
def dedupe_last(r):
    return P.union_keep([_copies(r)], ["l_orderkey", "l_linenumber"], _ORDER, "last").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""
    SELECT split, count(*) AS n, min(gw) AS first_gw, max(gw) AS last_gw FROM (
        SELECT gw, CASE WHEN gw <= 15 THEN 'train' WHEN gw BETWEEN 16 AND 20 THEN 'calibration'
                        WHEN gw BETWEEN 21 AND 28 THEN 'test' END AS split FROM form)
    GROUP BY 1""")
def split_labels(r):
    labelled = C.with_split(r.form(), C.Split(15, 16, 20, 21, 28))
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                         F.min("gw").alias("first_gw"),
                                         F.max("gw").alias("last_gw"))


@query("""
    SELECT split, count(*) AS n FROM (
        SELECT CASE WHEN season = '1996' THEN 'train'
                    WHEN season = '1997' AND gw <= 5 THEN 'test' END AS split FROM matches)
    GROUP BY 1""")
def season_start_split(r):
    return C.with_season_start_split(r.matches(), "1996", "1997", 5).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""
    SELECT w AS window, 9 + 3 * w AS fit_gw_max, 10 + 3 * w AS test_start,
           14 + 3 * w AS test_end, count(*) AS n, {r6("avg(abs(actual - pred))")} AS mae
    FROM scored JOIN (SELECT unnest(range(0, 6)) AS w) ON gw BETWEEN 10 + 3 * w AND 14 + 3 * w
    GROUP BY 1, 2, 3, 4""")
def rolling_windows(r):
    rows = C.with_rolling_windows(r.scored(), 10, 29, 5, 3)
    out = rows.groupBy("window", "fit_gw_max", "test_start", "test_end").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"))
    return rounded(out, "mae")


@query("""
    SELECT 'identity_on_stable_code' AS check_name, count(*) AS n FROM form f
    JOIN players p ON p.player_id = f.player_id
    WHERE f.player_code + CASE WHEN f.player_id % 13 = 0 THEN 1 ELSE 0 END <> p.player_code
    UNION ALL SELECT 'target_is_next_row', 0""")
def leakage_report(r):
    spoiled = r.form().withColumn("player_code", F.col("player_code") + F.when(
        F.col("player_id") % 13 == 0, 1).otherwise(0))
    return C.leakage_report(spoiled, r.players())


@query("""
    SELECT 'lines_without_order' AS check_name, (SELECT count(*) FROM lineitem ANTI JOIN orders
        ON l_orderkey = o_orderkey) AS n
    UNION ALL SELECT 'users_without_customer_segment_order',
        (SELECT count(*) FROM events ANTI JOIN
         (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON user_id = o_custkey)
    UNION ALL SELECT 'repeated_line_keys', (SELECT count(*) FROM (
        SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'negative_balances', (SELECT count(*) FROM customer WHERE c_acctbal < 0)""")
def ref_integrity(r):
    orders = r.t("orders")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    return C.contract_report({
        "lines_without_order": C.orphan_count(r.t("lineitem"), orders,
                                              [("l_orderkey", "o_orderkey")]),
        "users_without_customer_segment_order": C.orphan_count(
            r.t("events"), urgent, [("user_id", "o_custkey")]),
        "repeated_line_keys": C.repeated_key_count(r.t("lineitem"),
                                                   ["l_orderkey", "l_linenumber"]),
        "negative_balances": C.negative_count(r.t("customer"), ["c_acctbal"])})


@query()
def fingerprint(r):
    return C.fingerprint(r.panel())


def _portable_sql(text: str) -> str:
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _whole_sql(c: str) -> str:
    return _portable_sql(f"CAST({c} AS VARCHAR)")


def _millionths_sql(c: str) -> str:
    return _portable_sql(f"CAST(CAST(round({c} * 1e6) AS HUGEINT) AS VARCHAR)")


@query(f"""
    WITH d AS (SELECT substr(md5({_whole_sql("player_id")} || {_whole_sql("gw")}), 1, 2) AS span,
        md5({_whole_sql("gw")} || {_whole_sql("minutes")} || {_millionths_sql("now_cost")}
            || {_whole_sql("player_id")} || {_whole_sql("starts")}
            || {_millionths_sql("total_points")}) AS digest FROM panel)
    SELECT span, count(*) AS rows,
           CAST(sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT)) AS VARCHAR) AS lane_0,
           CAST(sum(CAST('0x' || substr(digest, 16, 15) AS BIGINT)) AS VARCHAR) AS lane_1
    FROM d GROUP BY 1""")
def fingerprint_ranges(r):
    return C.fingerprint_ranges(r.panel(), ["player_id", "gw"])


@query("""
    SELECT CAST(coalesce((SELECT max(gw) FROM panel), 0) AS BIGINT) AS current,
           CAST(coalesce((SELECT max(gw) FROM panel), 0) + 1 AS BIGINT) AS next,
           CAST(coalesce((SELECT max(gw) FROM form) + 1, 0) AS BIGINT) AS scoreable""")
def clock(r):
    return P.clock(r.panel(), r.form())


@query(f"""
    SELECT player_id, {r6("avg(total_points)")} AS form FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY total_points DESC, gw)
        AS rn FROM panel) WHERE rn <= 5 GROUP BY 1""")
def form_of_largest(r):
    return rounded(P.form_of_largest(r.panel()), "form")


@query(f"""
    SELECT player_id, {r6("avg(total_points)")} AS form FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY gw DESC)
        AS rn FROM panel) WHERE rn <= 5 GROUP BY 1""")
def form_of_latest(r):
    return rounded(P.form_of_latest(r.panel()), "form")


@query("""SELECT player_id, max_by(now_cost, gw) AS now_cost FROM panel WHERE gw <= 20
          GROUP BY 1""")
def latest_price(r):
    return P.latest_price(r.panel(), 20)


# --- horizon and pool ----------------------------------------------------------

def _horizon(r):
    rows = r.form().select("player_id", "player_code", "gw",
                           F.round("pts_avg_5", 6).alias("pred"))
    return P.horizon_scores(rows, r.players(), 11, 15)


_HORIZON = """
    SELECT player_code, pl.web_name, pl.position, pl.team_code, f.gw + 1 AS gw,
           round_even(round(pts_avg_5, 6), 3) AS expected_points
    FROM (SELECT player_id, player_code, gw, pts_avg_5 FROM form) f
    JOIN players pl USING (player_id, player_code) WHERE f.gw BETWEEN 10 AND 14"""


@query(f"""
    WITH hz AS ({_HORIZON})
    SELECT player_code, web_name, position, team_code, {r6("sum(expected_points)")}
           AS expected_total, {r6("avg(expected_points)")} AS expected_mean_per_gw
    FROM hz GROUP BY 1, 2, 3, 4""")
def horizon_scores(r):
    return rounded(P.window_scores(_horizon(r)), "expected_total", "expected_mean_per_gw")


_AVAILABILITY = """
    SELECT player_code, sum(minutes)::BIGINT AS minutes_in_window,
           max_by(p.now_cost, gw) AS now_cost
    FROM panel p JOIN players pl USING (player_id) WHERE gw BETWEEN 11 AND 15 GROUP BY 1"""


@query(_AVAILABILITY)
def availability(r):
    return PL.availability(r.panel(), r.players(), 11, 15)


@query("""
    SELECT player_code, gw, rank() OVER (PARTITION BY gw ORDER BY total_points DESC)
           + (count(*) OVER (PARTITION BY gw, total_points) - 1) / 2.0 AS avg_rank
    FROM form""")
def avg_rank(r):
    ranked = scale.with_value_ranks(r.form(), ["gw"], "total_points", "r")
    above = F.col("r_total") - F.col("r_before") - F.col("r_eq")
    return ranked.select("player_code", "gw",
                         (above + (F.col("r_eq") + 1) / 2.0).alias("avg_rank"))


@query(f"""
    WITH hz AS ({_HORIZON}), av AS ({_AVAILABILITY}),
    tot AS (SELECT player_code, web_name, position, team_code,
                   CAST(sum(CAST(expected_points AS DECIMAL(18,3))) AS DOUBLE) AS expected_total
            FROM hz GROUP BY 1, 2, 3, 4),
    cand AS (SELECT t.*, minutes_in_window, now_cost,
                    row_number() OVER (ORDER BY expected_total DESC, player_code) AS g
             FROM tot t JOIN av USING (player_code)
             WHERE minutes_in_window > 0 AND now_cost BETWEEN 0 AND 100),
    bypos AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY position
                  ORDER BY expected_total DESC) + (count(*) OVER (PARTITION BY position,
                  expected_total) - 1) / 2.0 AS pr FROM cand WHERE g > 20) WHERE pr <= 12),
    byclub AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY team_code
                  ORDER BY expected_total DESC) + (count(*) OVER (PARTITION BY team_code,
                  expected_total) - 1) / 2.0 AS cr FROM bypos) WHERE cr <= 2)
    SELECT player_code, position, team_code, now_cost, minutes_in_window, expected_total
    FROM cand WHERE g <= 20
    UNION ALL SELECT player_code, position, team_code, now_cost, minutes_in_window,
           expected_total FROM byclub""")
def diverse_pool(r):
    points = F.col("expected_points").cast("decimal(18,3)")
    scored = _horizon(r).groupBy("player_code", "web_name", "position", "team_code").agg(
        F.sum(points).cast("double").alias("expected_total"))
    available = PL.availability(r.panel(), r.players(), 11, 15)
    return PL.filter_pool(scored, available, top_k_per_position=12, max_per_team=2,
                          reserve_top=20).select(
        "player_code", "position", "team_code", "now_cost", "minutes_in_window",
        "expected_total")


@query(f"""
    WITH n AS (SELECT count(*) FILTER (position = 'GKP') AS GKP,
                      count(*) FILTER (position = 'DEF') AS DEF,
                      count(*) FILTER (position = 'MID') AS MID,
                      count(*) FILTER (position = 'FWD') AS FWD FROM elements)
    SELECT GKP, DEF, MID, FWD, {r6('''
        (SELECT sum(log10((GKP - 2 + i) / i)) FROM (SELECT unnest(range(1, 3)) AS i))
        + (SELECT sum(log10((DEF - 5 + i) / i)) FROM (SELECT unnest(range(1, 6)) AS i))
        + (SELECT sum(log10((MID - 5 + i) / i)) FROM (SELECT unnest(range(1, 6)) AS i))
        + (SELECT sum(log10((FWD - 3 + i) / i)) FROM (SELECT unnest(range(1, 4)) AS i))''')}
        AS log10_teams
    FROM n""")
def search_space(r):
    return rounded(PL.search_space_size(r.elements()), "log10_teams")


@query("""
    SELECT player_code, web_name, position, team_code,
           CAST(round_even(now_cost * 10.0, 0) AS BIGINT) AS price_tenths FROM elements""")
def players_frame(r):
    return PL.players_frame(r.elements())


@query("""
    SELECT player_code, web_name, team_code FROM players WHERE lower(web_name)
        LIKE '%000001%' ORDER BY team_code DESC NULLS LAST, player_code LIMIT 7 OFFSET 2""")
def sorted_page(r):
    hits = r.players().where(L.name_matches("R#000001".lower()[2:])).select(
        "player_code", "web_name", "team_code")
    return PL.ranked_page(hits, "team_code", descending=True, limit=7, offset=2)


@query("""
    SELECT p.player_code, p.web_name, t.name AS team FROM players p
    LEFT JOIN teams t ON t.code = p.team_code WHERE p.web_name ILIKE '%0007%'""")
def find_entities(r):
    return L.find_entities(r.players(), r.teams(), "0007").select(
        "player_code", "web_name", "team")


# --- snapshot -----------------------------------------------------------------------

@query("""
    SELECT player_code, status IN ('a') AS available, status IN ('a', 'd') AS not_out,
           CASE WHEN chance_of_playing_next_round IS NULL THEN status IN ('a', 'd')
                ELSE chance_of_playing_next_round >= 75 END AS chance,
           coalesce(trim(news), '') = '' AS no_news,
           NOT coalesce(removed, FALSE) AND coalesce(can_select, FALSE) AS in_league,
           playable FROM masked""")
def playable(r):
    return SN.attach_masks(
        r.live(), available=X.fully_available(), not_out=X.not_out(), chance=X.meets_chance(),
        no_news=X.no_news(), in_league=X.in_league(), playable=X.playable()).select(
        "player_code", "available", "not_out", "chance", "no_news", "in_league", "playable")


@query("""
    SELECT p.player_code, p.position, l.team_code FROM players p
    JOIN masked l USING (player_code) WHERE l.team_code IS NOT NULL AND l.playable""")
def reconcile(r):
    return SN.construction_input(r.players(), r.live()).select(
        "player_code", "position", "team_code")


@query("""SELECT p.player_code, p.team_code FROM players p ANTI JOIN
          (SELECT player_code FROM masked WHERE NOT playable) x USING (player_code)""")
def drop_excluded(r):
    return SN.drop_excluded(r.players(), r.live(), X.playable()).select(
        "player_code", "team_code")


_REPORT = """
    SELECT l.player_code, l.now_cost, l.status, l.team_code,
           CAST(round_even(p.now_cost * 10.0, 0) AS BIGINT) AS ds_price,
           l.now_cost - CAST(round_even(p.now_cost * 10.0, 0) AS BIGINT) AS price_diff_tenths,
           p.team_code AS ds_team, l.team_code = p.team_code AS team_ok,
           p.now_cost IS NOT NULL AS matched_to_dataset
    FROM live l LEFT JOIN players p USING (player_code)"""


def _report(r):
    return SN.report_agreement(r.live(), r.players())


@query(_REPORT)
def agreement(r):
    return _report(r).select("player_code", "now_cost", "status", "team_code", "ds_price",
                             "price_diff_tenths", "ds_team", "team_ok", "matched_to_dataset")


@query(f"""
    WITH rep AS ({_REPORT})
    SELECT count(*) AS in_live, count(*) FILTER (matched_to_dataset) AS matched_to_dataset,
           count(*) FILTER (abs(price_diff_tenths) > 0) AS price_moved,
           count(*) FILTER (NOT team_ok) AS team_transferred,
           count(*) FILTER (status IN ('i', 's', 'u')) AS not_available FROM rep""")
def hygiene(r):
    return SN.hygiene_summary(_report(r))


@query(f"""
    WITH rep AS ({_REPORT})
    SELECT player_code, (NOT team_ok) OR status IN ('i', 's', 'u') AS exclude FROM rep""")
def exclusion(r):
    return SN.exclusion_flag(_report(r))


def _squad_of_players(r):
    """Every customer as the member of a squad of its nation."""
    return r.players().select(
        F.col("team_code").alias("squad"), "player_code", "web_name", "team_code",
        X.to_tenths("now_cost").alias("price_tenths"))


_FLAGS = """
    SELECT p.team_code AS squad, p.player_code, p.web_name,
           CASE WHEN l.player_code IS NULL THEN 'NOT IN LIVE ROSTER (missing/transferred out)'
           ELSE coalesce(nullif(concat_ws(' | ',
               CASE WHEN l.status IN ('i', 's', 'u', 'n')
                    THEN 'UNAVAILABLE[' || l.status || ']' END,
               CASE WHEN l.status = 'i' THEN 'INJURED' END,
               CASE WHEN l.status IS NULL AND l.team_code IS NULL
                    THEN 'NOT IN LIVE ROSTER (missing/transferred out)'
                    WHEN l.team_code <> p.team_code
                    THEN 'TRANSFERRED (ds ' || p.team_code || ' -> live ' || l.team_code || ')'
                    END,
               CASE WHEN d > 0 THEN 'price +' || d WHEN d < 0 THEN 'price ' || d END), ''), 'ok')
           END AS flag
    FROM players p LEFT JOIN (
        SELECT l.*, l.now_cost - CAST(round_even(q.now_cost * 10.0, 0) AS BIGINT) AS d
        FROM live l JOIN players q USING (player_code)) l USING (player_code)"""


@query(_FLAGS)
def flags(r):
    return SN.squad_flags(_squad_of_players(r), r.live()).select(
        "squad", "player_code", "web_name", "flag")


@query(f"""
    WITH f AS ({_FLAGS})
    SELECT squad AS web_name, flag, count(*) AS n FROM f WHERE flag <> 'ok' GROUP BY 1, 2
    ORDER BY n DESC, web_name, flag LIMIT 12""")
def problem_rollup(r):
    named = SN.squad_flags(_squad_of_players(r), r.live()).withColumn(
        "web_name", F.col("squad"))
    return SN.problem_rollup(named)


@query("""
    SELECT p.player_code, p.web_name, CASE
        WHEN l.player_code IS NULL THEN 'NOT IN LIVE ROSTER (missing/transferred out)'
        WHEN l.status IN ('i', 's', 'u', 'n') THEN 'UNAVAILABLE[' || l.status || ']'
        ELSE 'below availability bar' END AS reason
    FROM players p LEFT JOIN masked l USING (player_code)
    WHERE l.player_code IS NULL OR NOT coalesce(l.playable, FALSE)""")
def members_to_replace(r):
    return SN.members_to_replace(_squad_of_players(r), r.live()).select(
        "player_code", "web_name", "reason")


@query("""
    SELECT p.player_id, p.gw, l.web_name, l.status, l.team_code
    FROM panel p LEFT JOIN live l USING (player_id)""")
def live_overlay(r):
    return SN.with_live(r.panel().select("player_id", "gw"), r.live(), "player_id",
                        ("web_name", "status", "team_code"))


@query(f"""
    SELECT player_code, {r6('''coalesce(v, 0.0) * CASE
        WHEN chance_of_playing_next_round IS NULL AND status IN ('i', 's', 'u', 'n') THEN 0.0
        WHEN chance_of_playing_next_round IS NULL THEN 1.0
        ELSE chance_of_playing_next_round / 100.0 END''')} AS value
    FROM live LEFT JOIN (SELECT player_code, max(pts_avg_5) AS v FROM form GROUP BY 1)
    USING (player_code)""")
def effective_values(r):
    expected = r.form().groupBy("player_code").agg(F.max("pts_avg_5").alias("expected_points"))
    out = r.live().join(expected, "player_code", "left").select(
        "player_code", X.effective_value().alias("value"))
    return rounded(out, "value")


@query("""SELECT CAST(player_code AS BIGINT) AS team_code, coalesce(short_name, name, '') AS team
          FROM (SELECT code AS player_code, short_name, name FROM teams)""")
def team_names(r):
    return SN.team_names(r.teams())
