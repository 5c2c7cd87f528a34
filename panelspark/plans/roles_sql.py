"""The roles of :mod:`panelspark.plans.bindings` as SQL common table expressions."""

from __future__ import annotations

import re

from panelspark.schemas import QS

QS_SQL = "[" + ", ".join(str(q) for q in QS) + "]"


def corr_sql(x: str, y: str) -> str:
    """Rounded correlation, null where one side does not vary."""
    return r6(f"CASE WHEN isfinite(corr({x}, {y})) THEN corr({x}, {y}) END")


def r6(expression: str) -> str:
    """Rounded to 6 decimals, without a negative zero."""
    return f"(round({expression}, 6) + 0.0)"


ROLES = {
    "panel": """
        SELECT user_id AS player_id, CAST(day(ts) AS BIGINT) AS gw,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_points,
               CAST(sum(CASE WHEN event_type IN ('click', 'purchase')
                        THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)
                        ELSE 0 END) AS BIGINT) AS minutes,
               count(*) FILTER (event_type = 'purchase') AS starts,
               CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS now_cost
        FROM events GROUP BY 1, 2""",
    "players": """
        SELECT c_custkey + 1000000 AS player_code, c_custkey AS player_id,
               c_mktsegment AS first_name, c_name AS second_name, c_name AS web_name,
               CAST(c_nationkey AS BIGINT) AS team_code,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GKP' WHEN 'BUILDING' THEN 'DEF'
                    WHEN 'FURNITURE' THEN 'MID' WHEN 'HOUSEHOLD' THEN 'FWD'
                    ELSE 'UNK' END AS position,
               c_acctbal / 100.0 AS now_cost
        FROM customer""",
    "team_history": """
        SELECT user_id AS player_id, CAST(day(ts) AS BIGINT) AS gw,
               min(event_id) % 25 AS team_code
        FROM events WHERE event_type = 'signup' GROUP BY 1, 2""",
    "teams": """
        SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS name,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE substr(n_name, 8, 10) END
               AS short_name
        FROM nation""",
    "matches": """
        SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, o_orderkey AS match_id,
               CAST(day(o_orderdate) AS BIGINT) AS gw,
               CAST(c_nationkey AS BIGINT) AS home_team, CAST(s_nationkey AS BIGINT) AS away_team,
               CASE WHEN o_orderstatus <> 'P' THEN na END AS home_score,
               CASE WHEN o_orderstatus <> 'P' THEN nr END AS away_score,
               CASE WHEN o_orderstatus <> 'P' THEN c_acctbal END AS home_team_elo,
               CASE WHEN o_orderstatus <> 'P' THEN s_acctbal END AS away_team_elo,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'cup' ELSE 'prem' END AS tournament,
               o_orderstatus <> 'P' AS finished
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN (SELECT l_orderkey, min(l_suppkey) AS sk,
                     count(*) FILTER (l_returnflag = 'A') AS na,
                     count(*) FILTER (l_returnflag = 'R') AS nr
              FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        JOIN supplier ON s_suppkey = sk""",
    "sides": """
        SELECT gw, match_id, home_team AS team_code, away_team AS opponent_team_code,
               TRUE AS was_home, home_team_elo AS home_elo, away_team_elo AS opponent_elo,
               home_score AS goals, away_score AS conceded, tournament
        FROM matches
        UNION ALL
        SELECT gw, match_id, away_team, home_team, FALSE, away_team_elo, home_team_elo,
               away_score, home_score, tournament
        FROM matches""",
    "fixtures": """
        SELECT gw, team_code, opponent_team_code, was_home, home_elo, opponent_elo
        FROM (SELECT *, row_number() OVER (PARTITION BY gw, team_code
                                           ORDER BY was_home DESC, match_id) AS rn
              FROM sides WHERE tournament = 'prem')
        WHERE rn = 1""",
    "features": """
        SELECT player_id, player_code, gw, team_code, opponent_team_code, was_home, home_elo,
               opponent_elo, prev_points, pts_avg_3, pts_avg_5, total_points, next_points
        FROM (SELECT p.player_id, player_code, p.gw,
                     coalesce(h.team_code, pl.team_code) AS team_code, total_points,
                     lag(total_points) OVER w AS prev_points,
                     avg(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
                     AS pts_avg_3,
                     avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
                     AS pts_avg_5,
                     lead(total_points) OVER w AS next_points
              FROM panel p LEFT JOIN players pl ON pl.player_id = p.player_id
              LEFT JOIN team_history h ON h.player_id = p.player_id AND h.gw = p.gw
              WINDOW w AS (PARTITION BY p.player_id ORDER BY p.gw))
        LEFT JOIN fixtures USING (gw, team_code)
        WHERE prev_points IS NOT NULL AND pts_avg_3 IS NOT NULL AND pts_avg_5 IS NOT NULL""",
    "form": """
        SELECT * FROM (
            SELECT p.*, player_code, position, team_code, web_name,
                   lag(total_points) OVER w AS prev_points,
                   avg(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
                   AS pts_avg_3,
                   avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
                   AS pts_avg_5,
                   lead(total_points) OVER w AS next_points
            FROM panel p JOIN (SELECT player_id, player_code, position, team_code, web_name
                               FROM players) pl USING (player_id)
            WINDOW w AS (PARTITION BY p.player_id ORDER BY p.gw))
        WHERE prev_points IS NOT NULL""",
    "scored": """
        SELECT player_id, player_code, gw, position, team_code, next_points AS actual,
               round(pts_avg_3, 6) AS pred, round(pts_avg_5, 6) AS pred_5, prev_points, now_cost
        FROM form WHERE next_points IS NOT NULL""",
    "residuals": """
        SELECT s.*, opponent_team_code, actual - pred AS resid
        FROM scored s JOIN fixtures USING (gw, team_code)""",
    "live": """
        SELECT o_custkey + 1000000 AS player_code, o_custkey AS player_id, c_name AS web_name,
               CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL
                    WHEN o_orderkey % 7 = 0 THEN (c_nationkey + 1) % 25
                    ELSE c_nationkey END AS BIGINT) AS team_code,
               o_orderkey % 4 + 1 AS element_type,
               CAST(round_even(c_acctbal / 100.0 * 10.0, 0) AS BIGINT)
               + CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 5 - 2 ELSE 0 END AS now_cost,
               CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'd' ELSE
                    CASE o_orderkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 's' ELSE 'u' END
               END AS status,
               CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'knock' END AS news,
               CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 50
                    WHEN '3-MEDIUM' THEN 75 WHEN '5-LOW' THEN 100 END AS DOUBLE)
               AS chance_of_playing_next_round,
               CASE WHEN o_orderkey % 9 = 0 THEN 'none'
                    ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS selected_by_percent,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL
                    ELSE CAST(o_orderkey % 12 AS VARCHAR) END AS ep_next,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 11 = 0 END AS removed,
               CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderkey % 13 <> 0 END
               AS can_select
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                         ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        JOIN customer ON o_custkey = c_custkey WHERE rn = 1""",
    "masked": """
        SELECT *, (NOT coalesce(removed, FALSE) AND coalesce(can_select, FALSE)
                   AND status IN ('a', 'd')
                   AND CASE WHEN chance_of_playing_next_round IS NULL
                            THEN status IN ('a', 'd')
                            ELSE chance_of_playing_next_round >= 75 END) AS playable
        FROM live""",
    "elements": """
        SELECT p_partkey AS player_code, p_partkey AS player_id, p_name AS web_name,
               CASE WHEN p_size <= 8 THEN 'GKP' WHEN p_size <= 22 THEN 'DEF'
                    WHEN p_size <= 38 THEN 'MID' ELSE 'FWD' END AS position,
               CAST(substr(p_brand, 7, 10) AS BIGINT) AS team_code,
               p_retailprice / 100.0 AS now_cost,
               CAST(round_even(p_retailprice / 100.0 * 10.0, 0) AS BIGINT) AS price_tenths
        FROM part""",
    "pool": """
        SELECT e.*, coalesce(value, 0.0) AS value FROM elements e LEFT JOIN (
            SELECT l_partkey AS player_code,
                   round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4)
                   AS value
            FROM lineitem GROUP BY 1) USING (player_code)""",
    "lines": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "picks": """
        SELECT entry_id, gw, element, slot AS position,
               CASE WHEN slot = 1 THEN 2 WHEN slot <= 4 THEN 1 ELSE 0 END AS multiplier,
               slot = 1 AS is_captain, slot = 2 AS is_vice_captain, quantity
        FROM (SELECT customer + (place - 1) // 15 * 1000000000000 AS entry_id, gw, element,
                     quantity, (place - 1) % 15 + 1 AS slot
              FROM (SELECT *, row_number() OVER (PARTITION BY customer, gw
                                                 ORDER BY quantity DESC, element) AS place
                    FROM (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS BIGINT) AS gw,
                           l_partkey AS element,
                           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
                    FROM lines GROUP BY 1, 2, 3)))""",
    "actuals": """
        SELECT l_partkey AS player_code, CAST(year(o_orderdate) AS BIGINT) AS gw,
               count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS minutes,
               CAST(coalesce(sum(CASE WHEN l_returnflag = 'A'
                    THEN CAST(l_quantity AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_points
        FROM lines GROUP BY 1, 2""",
    "per_gw": """
        SELECT l_partkey AS player_code, CAST(year(o_orderdate) AS BIGINT) AS gw,
               round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3)
               AS expected_points
        FROM lines GROUP BY 1, 2""",
    "squad_picks": """
        SELECT p.entry_id, p.gw, p.element AS player_code, p.position AS slot, e.position,
               e.team_code, e.price_tenths, e.web_name, p.multiplier, p.is_captain,
               p.is_vice_captain AS is_vice, coalesce(a.minutes, 0) > 0 AS played,
               coalesce(a.total_points, 0.0) AS points
        FROM picks p JOIN elements e ON e.player_code = p.element
        LEFT JOIN actuals a ON a.player_code = p.element AND a.gw = p.gw""",
    "members": """
        SELECT entry_id || '-' || gw AS squad, p.position AS slot, pool.*
        FROM picks p JOIN pool ON pool.player_code = p.element""",
    "basket": """
        SELECT team_id, b.player_code, position, team_code, price_tenths, expected_total
        FROM (SELECT o_custkey AS team_id, l_partkey AS player_code,
                     CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS expected_total
              FROM lines GROUP BY 1, 2) b JOIN elements e ON e.player_code = b.player_code""",
    "month_totals": """
        SELECT o_custkey AS team_id,
               CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS gw,
               CAST(sum(CAST(floor(o_totalprice) AS DECIMAL(18,2))) AS DOUBLE) / 997.0 AS gw_total,
               count(*) AS orders
        FROM orders GROUP BY 1, 2""",
    "squad_dist": """
        SELECT team_id, gw, gw_total AS sample_mean,
               (orders - 1) * 25.0 AS sample_std FROM month_totals""",
    "vectors": f"""
        SELECT l_partkey AS player_code,
               quantile_cont(l_extendedprice, {QS_SQL}) AS vector
        FROM lineitem GROUP BY 1""",
    "standings": """
        SELECT c_custkey AS entry_id, c_name AS entry_name, c_mktsegment AS player_name,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 100 END AS rank,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey * 13) % 500 END AS total
        FROM customer""",
    "league_matches": """
        SELECT CAST(year(o_orderdate) AS BIGINT) AS event, o_orderkey AS match_id,
               o_custkey AS entry_1_entry,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    ELSE (SELECT max(c_custkey) FROM customer) - o_custkey END AS entry_2_entry,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 90 END
               AS entry_1_points,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey * 7) % 90 END
               AS entry_2_points,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 19 = 0 END AS is_bye
        FROM orders""",
    "history": """
        SELECT o_custkey AS entry_id, CAST(year(o_orderdate) AS BIGINT) AS event,
               count(*) AS points, max(o_orderkey) AS total_points, min(o_orderkey) AS rank,
               count(*) FILTER (o_orderstatus = 'F') AS points_on_bench,
               count(*) FILTER (o_orderstatus = 'P') AS event_transfers
        FROM orders GROUP BY 1, 2""",
}


def _uses(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", text))
    return [name for name in ROLES if name in words]


def with_roles(body: str) -> str:
    """The statement with the role tables it mentions, each after those it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in _uses(ROLES[name]):
            if needed != name:
                visit(needed)
        ordered.append(name)

    for name in _uses(body):
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({ROLES[name].strip()})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
