"""Squad, league and swap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import checks as C
from panelspark.operators import league as L
from panelspark.operators import scale
from panelspark.operators import snapshot as SN
from panelspark.operators import squads as SQ
from panelspark.operators import swaps as SW
from panelspark.plans.bindings import XI
from panelspark.plans.registry import query, rounded, rounded_vector
from panelspark.plans.roles_sql import r6
from panelspark.session import stored

# Line-ups of the squads made of order lines: four starters.
FORMATIONS = ((1, 1, 1, 1), (1, 1, 2, 0), (1, 2, 1, 0), (0, 1, 2, 1), (0, 2, 1, 1),
              (0, 2, 2, 0), (0, 1, 1, 2))
SWAP = dict(max_per_club=2)


# --- line-ups and captains --------------------------------------------------------------

_FORMATION_ROWS = ", ".join(f"({i}, {f[0]}, {f[1]}, {f[2]}, {f[3]})"
                            for i, f in enumerate(FORMATIONS))
_XI = f"""
    WITH k AS (SELECT squad, player_code, position, value, row_number() OVER (
                   PARTITION BY squad, position ORDER BY value DESC, player_code) AS rk
               FROM members),
    f(i, g, d, m, w) AS (VALUES {_FORMATION_ROWS}),
    o AS (SELECT squad, i, g, d, m, w,
                 sum(CASE WHEN rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d
                               WHEN 'MID' THEN m ELSE w END THEN value ELSE 0 END) AS score,
                 count(*) FILTER (rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d
                               WHEN 'MID' THEN m ELSE w END) AS n
          FROM k CROSS JOIN f GROUP BY 1, 2, 3, 4, 5, 6),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY squad
              ORDER BY round(score, 9) DESC, i) AS rn FROM o WHERE n = 4) WHERE rn = 1)"""


def _line_up(r):
    members = r.members().withColumn("value", F.col("value").cast("decimal(18,4)"))
    exact = members.withColumn("value", F.col("value").cast("double"))
    return SQ.best_xi(exact, formations=FORMATIONS)


@query(_XI + f"""
    SELECT k.squad, k.player_code, {r6("score")} AS xi_score,
           rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d WHEN 'MID' THEN m
                 ELSE w END AS is_starter
    FROM k JOIN b USING (squad)""")
def best_xi(r):
    out = _line_up(r).select("squad", "player_code", "xi_score", "is_starter")
    return rounded(out, "xi_score")


@query(_XI + """
    , p AS (SELECT k.*, rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d
                   WHEN 'MID' THEN m ELSE w END AS s FROM k JOIN b USING (squad))
    SELECT squad, player_code, CAST(row_number() OVER (PARTITION BY squad
           ORDER BY position <> 'GKP', value DESC, player_code) AS INTEGER) AS bench_order
    FROM p WHERE NOT s""")
def bench_order(r):
    return _line_up(r).where(~F.col("is_starter")).select("squad", "player_code", "bench_order")


@query("""
    WITH k AS (SELECT squad, player_code, team_code, row_number() OVER (PARTITION BY squad
                   ORDER BY value DESC, slot) AS rk FROM members WHERE slot <= 4),
    c AS (SELECT squad, player_code AS captain, team_code AS club FROM k WHERE rk = 1),
    v AS (SELECT k.squad, min_by(player_code, rk) AS v FROM k JOIN c USING (squad)
          WHERE k.team_code <> club GROUP BY 1),
    two AS (SELECT squad, player_code AS v2 FROM k WHERE rk = 2)
    SELECT squad, captain, coalesce(v, v2) AS vice_captain FROM c LEFT JOIN v USING (squad)
    LEFT JOIN two USING (squad)""")
def captains(r):
    return SQ.captains(r.members().where(F.col("slot") <= XI), expected="value")


@query("""
    SELECT squad, player_code FROM (SELECT *, row_number() OVER (PARTITION BY squad, position
        ORDER BY value DESC, slot) AS rk FROM members)
    WHERE rk <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 5 ELSE 1 END""")
def predicted_xi(r):
    return SQ.predicted_xi(r.members(), prob="value").select("squad", "player_code")


@query("""
    SELECT squad, player_code FROM (SELECT *, row_number() OVER (PARTITION BY squad
        ORDER BY value, player_code) AS rk, count(*) OVER (PARTITION BY squad) AS n FROM members)
    WHERE rk <= ceil(n * 0.4)""")
def sellable(r):
    return SQ.bottom_sellable(r.members(), 0.4).select("squad", "player_code")


@query(f"""
    SELECT squad, player_code, {r6("0.6 * coalesce(total_points, 0.0) + 0.4 * value")} AS score
    FROM members LEFT JOIN (SELECT player_code, max(total_points) AS total_points
                            FROM actuals GROUP BY 1) USING (player_code)""")
def sell_scores(r):
    form = r.actuals().groupBy("player_code").agg(F.max("total_points").alias("form"))
    out = r.members().join(form, "player_code", "left").select(
        "squad", "player_code", X.sell_score("value", "form").alias("score"))
    return rounded(out, "score")


@query("""
    SELECT squad, player_code FROM (SELECT *, row_number() OVER (PARTITION BY squad, position
        ORDER BY slot) AS rk FROM members)
    WHERE rk <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 5 ELSE 1 END""")
def default_xi(r):
    return C.default_xi(r.members(), "slot").where("is_starter").select("squad", "player_code")


@query("""
    SELECT squad, count(*) AS n, count(*) FILTER (position = 'GKP') AS "GKP",
           count(*) FILTER (position = 'DEF') AS "DEF",
           count(*) FILTER (position = 'MID') AS "MID",
           count(*) FILTER (position = 'FWD') AS "FWD"
    FROM members GROUP BY 1 HAVING count(*) <> 8 OR count(*) FILTER (position = 'GKP') < 1
        OR count(*) FILTER (position = 'DEF') < 2 OR count(*) FILTER (position = 'MID') < 2
        OR count(*) FILTER (position = 'FWD') < 1""")
def basket_shapes(r):
    return C.basket_shape_problems(r.members(), squad_size=8,
                                   counts={"GKP": 1, "DEF": 2, "MID": 2, "FWD": 1})


_RULES = dict(counts={"GKP": 1, "DEF": 2, "MID": 2, "FWD": 1}, squad_size=6, xi_size=4,
              budget=900, max_per_club=1, minimums={"GKP": 1, "DEF": 1, "FWD": 1})


@query("""
    WITH m AS (SELECT *, slot <= 4 AS s FROM members),
    a AS (SELECT squad, count(*) AS n, CAST(sum(price_tenths) AS BIGINT) AS cost,
            count(*) FILTER (position = 'GKP') AS g, count(*) FILTER (position = 'DEF') AS d,
            count(*) FILTER (position = 'MID') AS m, count(*) FILTER (position = 'FWD') AS f,
            count(*) FILTER (s) AS xi, count(*) FILTER (s AND position = 'GKP') AS xg,
            count(*) FILTER (s AND position = 'DEF') AS xd,
            count(*) FILTER (s AND position = 'FWD') AS xf,
            max(team_code) FILTER (slot = 1) AS cc, max(team_code) FILTER (slot = 2) AS vc
          FROM m GROUP BY 1)
    SELECT squad, 'must have 6 players, got ' || n AS violation FROM a WHERE n <> 6
    UNION ALL SELECT squad, 'GKP count ' || g || ' != 1' FROM a WHERE g <> 1
    UNION ALL SELECT squad, 'DEF count ' || d || ' != 2' FROM a WHERE d <> 2
    UNION ALL SELECT squad, 'MID count ' || m || ' != 2' FROM a WHERE m <> 2
    UNION ALL SELECT squad, 'FWD count ' || f || ' != 1' FROM a WHERE f <> 1
    UNION ALL SELECT squad, 'cost ' || cost || ' > budget' FROM a WHERE cost > 900
    UNION ALL SELECT squad, 'starting XI needs 1 GKP' FROM a WHERE xg < 1
    UNION ALL SELECT squad, 'starting XI needs 1 DEF' FROM a WHERE xd < 1
    UNION ALL SELECT squad, 'starting XI needs 1 FWD' FROM a WHERE xf < 1
    UNION ALL SELECT squad, 'must have 4 starters, got ' || xi FROM a WHERE xi <> 4
    UNION ALL SELECT squad, 'captain and vice-captain should be different clubs' FROM a
              WHERE cc = vc
    UNION ALL SELECT squad, 'club ' || team_code || ' has ' || count(*) || ' > 1' FROM m
              GROUP BY squad, team_code HAVING count(*) > 1""")
def squad_violations(r):
    members = r.members().withColumns({
        "gw": F.lit(1), "is_starter": F.col("slot") <= XI, "is_captain": F.col("slot") == 1,
        "is_vice": F.col("slot") == 2})
    # Both counts of a squad are made where its rows are dealt to, in tasks of a bounded size.
    return C.squad_violations(scale.dealt(members, r.t("lineitem").count(), "squad"), **_RULES)


# --- settlement ---------------------------------------------------------------------------

def _settled_sql(source: str, xi: int = 4, min_def: int = 1) -> str:
    """Settlement as CTEs ``settled``, one step per starter slot; ``source`` is a table of
    picks with the results."""
    steps = [f"""
    src AS (SELECT * FROM {source}),
    step0 AS (SELECT entry_id, gw, max(player_code) FILTER (is_captain) AS cap,
                     max(player_code) FILTER (is_vice) AS vice,
                     []::BIGINT[] AS playing, []::BIGINT[] AS used, 0 AS nd,
                     count(*) FILTER (slot <= {xi} AND position = 'DEF') AS wd
              FROM src GROUP BY 1, 2)"""]
    for i in range(1, xi + 1):
        steps.append(f"""
    pick{i} AS (
        SELECT p.*, s.player_code AS sc, s.position AS sp, s.played AS sok,
               p.wd - CASE WHEN s.position = 'DEF' THEN 1 ELSE 0 END AS wd_next,
               (SELECT min_by(b.player_code, b.slot) FROM src b
                WHERE b.entry_id = p.entry_id AND b.gw = p.gw AND b.slot > {xi} AND b.played
                  AND NOT list_contains(p.used, b.player_code)
                  AND (b.position = 'GKP') = (s.position = 'GKP')
                  AND p.nd + p.wd - CASE WHEN s.position = 'DEF' THEN 1 ELSE 0 END
                      + CASE WHEN b.position = 'DEF' THEN 1 ELSE 0 END >= {min_def}) AS sub
        FROM step{i - 1} p LEFT JOIN src s
             ON s.entry_id = p.entry_id AND s.gw = p.gw AND s.slot = {i}),
    step{i} AS (
        SELECT k.entry_id, k.gw, cap, vice,
               CASE WHEN sok THEN list_append(playing, sc)
                    WHEN sub IS NOT NULL THEN list_append(playing, sub)
                    ELSE playing END AS playing,
               CASE WHEN NOT sok AND sub IS NOT NULL THEN list_append(used, sub)
                    ELSE used END AS used,
               nd + CASE WHEN sok THEN CASE WHEN sp = 'DEF' THEN 1 ELSE 0 END
                         WHEN sub IS NOT NULL AND b.position = 'DEF' THEN 1 ELSE 0 END AS nd,
               coalesce(wd_next, wd) AS wd
        FROM pick{i} k LEFT JOIN src b
             ON b.entry_id = k.entry_id AND b.gw = k.gw AND b.player_code = k.sub)""")
    steps.append(f"""
    who AS (SELECT *, CASE WHEN list_contains(playing, cap) THEN cap
                           WHEN list_contains(playing, vice) THEN vice END AS captain_doubled
            FROM step{xi}),
    settled AS (
        SELECT w.entry_id, w.gw, array_to_string(playing, ',') AS playing, len(used) AS subs,
               captain_doubled,
               (SELECT coalesce(sum(points * CASE WHEN player_code = captain_doubled THEN 2
                                             ELSE 1 END), 0.0) FROM src s
                WHERE s.entry_id = w.entry_id AND s.gw = w.gw
                  AND list_contains(w.playing, s.player_code)) AS gw_total,
               playing AS playing_list
        FROM who w)""")
    return ",".join(steps)


@query("WITH " + _settled_sql("squad_picks")
       + " SELECT entry_id, gw, playing, subs, captain_doubled, gw_total FROM settled")
def settlement(r):
    return r.settled().select(
        "entry_id", "gw", F.array_join(F.transform("playing", lambda c: c.cast("string")), ",")
        .alias("playing"), F.size("substituted_in").cast("bigint").alias("subs"),
        "captain_doubled", "gw_total")


def _table_sql(scores: str) -> str:
    """League table from a relation of (entry_id, gw, t)."""
    return f"""
    sc AS ({scores}),
    tot AS (SELECT entry_id, sum(t) AS resolved_score FROM sc GROUP BY 1),
    tab AS (SELECT s.entry_id, entry_name, player_name, resolved_score
            FROM standings s JOIN tot USING (entry_id)),
    met AS (SELECT entry_1_entry AS a, entry_2_entry AS b, x.t - y.t AS d FROM league_matches m
            JOIN sc x ON x.entry_id = entry_1_entry AND x.gw = event
            JOIN sc y ON y.entry_id = entry_2_entry AND y.gw = event
            WHERE NOT coalesce(is_bye, FALSE)),
    side AS (SELECT a AS entry_id, d FROM met UNION ALL SELECT b, -d FROM met),
    rec AS (SELECT entry_id, count(*) FILTER (d > 0) AS w, count(*) FILTER (d = 0) AS dr,
                   count(*) FILTER (d < 0) AS l FROM side GROUP BY 1)
    SELECT entry_id, entry_name, player_name, resolved_score, coalesce(w, 0) AS wins,
           coalesce(dr, 0) AS draws, coalesce(l, 0) AS losses,
           3 * coalesce(w, 0) + coalesce(dr, 0) AS league_points,
           row_number() OVER (ORDER BY 3 * coalesce(w, 0) + coalesce(dr, 0) DESC,
                              resolved_score DESC, entry_id) AS rank
    FROM tab LEFT JOIN rec USING (entry_id)"""


@query("WITH " + _settled_sql("squad_picks") + ","
       + _table_sql("SELECT entry_id, gw, gw_total AS t FROM settled"))
def h2h_table(r):
    out = L.h2h_table(r.standings(), r.league_matches(), r.settled())
    return L.final_ranks(out)


def _scores(r):
    """Score of an entry and period: its weighted quantities."""
    return r.picks().groupBy("entry_id", "gw").agg(
        F.sum(F.col("quantity") * F.col("multiplier")).alias("gw_total"))


@query("WITH " + _table_sql(
    "SELECT entry_id, gw, sum(quantity * multiplier) AS t FROM picks GROUP BY 1, 2"))
def league_table(r):
    return L.final_ranks(L.h2h_table(r.standings(), r.league_matches(), _scores(r)))


@query(f"""
    SELECT p.entry_id, p.gw, p.slot, p.player_code, coalesce(expected_points, 0.0)
           AS expected_points, {r6("coalesce(expected_points, 0.0) * p.multiplier")}
           AS weighted_expected, points AS actual_points
    FROM squad_picks p LEFT JOIN (SELECT player_code, gw + 1 AS gw, expected_points FROM per_gw) f
    USING (player_code, gw)""")
def team_rows(r):
    actuals = r.actuals().withColumnRenamed("player_code", "player_id")
    ahead = r.per_gw().withColumn("gw", F.col("gw") + 1)
    rows = SQ.team_rows(r.picks(), r.elements(), actuals, ahead)
    out = rows.select("entry_id", "gw", "slot", "player_code", "expected_points",
                      "weighted_expected", F.col("actual_points").cast("double")
                      .alias("actual_points"))
    return rounded(out, "weighted_expected")


@query(f"""
    SELECT p.entry_id, p.gw, {r6("sum(coalesce(expected_points, 0.0) * multiplier)")} AS xscore,
           count(*) AS player_count, CAST(max(h.points) AS DOUBLE) AS actual_score,
           {r6('''sum(coalesce(expected_points, 0.0) * multiplier)
               - CAST(max(h.points) AS DOUBLE)''')} AS error
    FROM picks p LEFT JOIN per_gw f ON f.player_code = p.element AND f.gw = p.gw
    JOIN history h ON h.entry_id = p.entry_id AND h.event = p.gw GROUP BY 1, 2""")
def team_summary(r):
    actuals = r.actuals().withColumnRenamed("player_code", "player_id")
    rows = SQ.team_rows(r.picks(), r.elements(), actuals, r.per_gw())
    out = SQ.team_summary(rows, r.history(), settled=False).select(
        "entry_id", "gw", "xscore", "player_count", "actual_score", "error")
    return rounded(out, "xscore", "error")


@query("WITH " + _settled_sql("squad_picks") + f""",
    x AS (SELECT p.entry_id, p.gw, sum(coalesce(expected_points, 0.0) * multiplier) AS xscore,
                 count(*) AS player_count
          FROM picks p LEFT JOIN per_gw f ON f.player_code = p.element AND f.gw = p.gw
          GROUP BY 1, 2)
    SELECT x.entry_id, x.gw, {r6("xscore")} AS xscore, player_count,
           CAST(h.points AS DOUBLE) AS history_score, gw_total AS actual_score,
           'event_live_settlement' AS score_source, {r6("xscore - gw_total")} AS error
    FROM x JOIN settled s USING (entry_id, gw)
    JOIN history h ON h.entry_id = x.entry_id AND h.event = x.gw""")
def team_summary_settled(r):
    actuals = r.actuals().withColumnRenamed("player_code", "player_id")
    rows = SQ.team_rows(r.picks(), r.elements(), actuals, r.per_gw())
    return rounded(SQ.team_summary(rows, r.history(), xi_size=XI, min_def=1, min_fwd=0),
                   "xscore", "error")


def _backtest(r):
    """Every squad of every year, followed for three years."""
    runs = (r.picks()
            .select((F.col("entry_id") * 10000 + F.col("gw")).alias("run"), "gw", F.col("element").alias("player_code"),
                    F.col("position").alias("slot"), "is_captain",
                    F.col("is_vice_captain").alias("is_vice"))
            .join(r.elements().select("player_code", "position"), "player_code"))
    return SQ.backtest(runs, r.actuals(), 3, r.per_gw(), xi_size=XI, min_def=1, min_fwd=0)


_RUNS = """
    base AS (SELECT entry_id * 10000 + gw AS entry_id, gw AS start, element AS player_code,
                    position AS slot, is_captain, is_vice_captain AS is_vice FROM picks),
    weekly AS (SELECT b.*, b.start + w.k AS gw, e.position, coalesce(a.minutes, 0) > 0 AS played,
                      coalesce(a.total_points, 0.0) AS points
               FROM base b CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS k) w
               JOIN elements e ON e.player_code = b.player_code
               LEFT JOIN actuals a ON a.player_code = b.player_code AND a.gw = b.start + w.k),
    """
_TOTALS = """,
    hit AS (SELECT s.entry_id, s.gw, sum(coalesce(expected_points, 0.0)
                   * CASE WHEN w.player_code = captain_doubled THEN 2 ELSE 1 END) AS pred
            FROM settled s JOIN weekly w ON w.entry_id = s.entry_id AND w.gw = s.gw
                 AND list_contains(playing_list, w.player_code)
            LEFT JOIN per_gw f ON f.player_code = w.player_code AND f.gw = w.gw GROUP BY 1, 2),
    dn AS (SELECT s.entry_id, s.gw, count(w.player_code) AS dnps FROM settled s LEFT JOIN weekly w
           ON w.entry_id = s.entry_id AND w.gw = s.gw AND w.slot <= 4
              AND NOT list_contains(playing_list, w.player_code) GROUP BY 1, 2),
    wk AS (SELECT s.*, coalesce(pred, 0.0) AS pred, dnps,
                  coalesce(pred, 0.0) - gw_total AS gap
           FROM settled s LEFT JOIN hit USING (entry_id, gw) JOIN dn USING (entry_id, gw)),
    runs AS (SELECT entry_id AS run, count(*) AS weeks, sum(gw_total) AS total_actual,
                    sum(pred) AS total_predicted, sum(pred) - sum(gw_total) AS gap,
                    CAST(sum(subs) AS BIGINT) AS substitutions,
                    CAST(sum(dnps) AS BIGINT) AS dnps, count(captain_doubled) AS captain_weeks,
                    max_by(gw, (round(gap, 6), -gw)) AS worst_gw
             FROM wk GROUP BY 1)"""


@query("WITH " + _RUNS.strip() + _settled_sql("weekly") + _TOTALS
       + f" SELECT run, weeks, total_actual, {r6('total_predicted')} AS total_predicted,"
         f" {r6('gap')} AS gap, substitutions, dnps, captain_weeks, worst_gw FROM runs")
def backtest(r):
    out = SQ.run_totals(rounded(_backtest(r), "gap"))
    return rounded(out, "total_predicted", "gap")


@query("WITH " + _RUNS.strip() + _settled_sql("weekly") + _TOTALS
       + f" SELECT count(*) AS evaluated, max(total_actual) AS best_actual,"
         f" {r6('avg(total_actual)')} AS mean_actual, {r6('avg(gap)')} AS mean_gap FROM runs")
def backtest_candidates(r):
    return rounded(SQ.candidate_metrics(SQ.run_totals(_backtest(r))), "mean_actual", "mean_gap")


@query("""
    WITH j AS (SELECT squad, vector, CASE WHEN slot = 1 THEN 2 ELSE 1 END AS w
               FROM members LEFT JOIN (
                   SELECT player_code, list_transform(vector, lambda v: floor(v)) AS vector
                   FROM vectors)
               USING (player_code) WHERE slot <= 4),
    s AS (SELECT squad, bool_and(vector IS NOT NULL) AS ok, """
       + ", ".join(f"sum(vector[{i + 1}] * w) AS s{i}" for i in range(9))
       + " FROM j GROUP BY 1)\n    SELECT squad, "
       + ", ".join(f"CASE WHEN ok THEN s{i} END AS v{i}" for i in range(9)) + " FROM s")
def lineup_vectors(r):
    starters = r.members().where(F.col("slot") <= XI).withColumn("is_captain",
                                                                 F.col("slot") == 1)
    known = r.vectors().withColumn(
        "vector", F.transform("vector", lambda v: F.floor(v).cast("double")))
    return rounded_vector(SQ.lineup_vectors(starters, known), "xi_quantiles", "squad",
                          labels=[f"v{i}" for i in range(9)])


# --- ownership ---------------------------------------------------------------------------------

@query(f"""
    SELECT element, {r6('''count(DISTINCT entry_id)
           / (SELECT count(DISTINCT entry_id) FROM picks)''')} AS ownership
    FROM picks GROUP BY 1""")
def ownership_all(r):
    return rounded(L.ownership_all(r.picks()), "ownership")


_LATEST = "(SELECT * FROM picks WHERE gw = (SELECT max(gw) FROM picks))"


@query(f"""
    SELECT element, round(100.0::DOUBLE * count(DISTINCT entry_id)
           / (SELECT count(DISTINCT entry_id) FROM {_LATEST}), 1) AS pct,
           count(DISTINCT entry_id) AS managers FROM {_LATEST} GROUP BY 1""")
def ownership_latest(r):
    return L.ownership_latest(r.picks())


@query(f"""
    WITH n AS (SELECT element, count(DISTINCT entry_id) AS m FROM {_LATEST} GROUP BY 1)
    SELECT entry_id, element, position, position <= 11 AS started, is_captain AS captain,
           m AS managers_owning, round(100.0::DOUBLE * m
               / (SELECT count(DISTINCT entry_id) FROM {_LATEST}), 1) AS pct
    FROM {_LATEST} JOIN n USING (element)""")
def exposure(r):
    return L.exposure(r.picks()).withColumn("position", F.col("position").cast("bigint"))


@query(f"""
    WITH n AS (SELECT element, count(DISTINCT entry_id) AS managers,
                      round(100.0::DOUBLE * count(DISTINCT entry_id)
                      / (SELECT count(DISTINCT entry_id) FROM {_LATEST}), 1) AS pct
               FROM {_LATEST} GROUP BY 1)
    SELECT p.player_code, p.web_name, p.position, pct AS own_league, managers,
           TRY_CAST(l.selected_by_percent AS DOUBLE) AS own_official,
           round(pct - TRY_CAST(l.selected_by_percent AS DOUBLE), 1) AS diff
    FROM players p JOIN n ON n.element = p.player_id LEFT JOIN live l USING (player_code)""")
def ownership_gap(r):
    return L.ownership_gap(L.ownership_latest(r.picks()), r.players(), r.live())


# --- results, standings, ratings -----------------------------------------------------------------

@query("""
    WITH s AS (
        SELECT event, match_id, entry_1_entry AS entry_id, entry_1_points AS points,
               entry_2_entry AS opponent, entry_2_points AS opponent_points, is_bye
        FROM league_matches
        UNION ALL SELECT event, match_id, entry_2_entry, entry_2_points, entry_1_entry,
               entry_1_points, is_bye FROM league_matches)
    SELECT event, entry_id, points, opponent, opponent_points,
           CASE WHEN opponent_points IS NULL OR points > opponent_points THEN 'W'
                WHEN points = opponent_points THEN 'D' ELSE 'L' END AS result
    FROM s WHERE NOT coalesce(is_bye, FALSE) AND entry_id IS NOT NULL AND points IS NOT NULL""")
def match_results(r):
    return L.match_results(r.league_matches())


@query("""
    SELECT s.*, h.points AS gw_points, s.entry_id = 5 AS is_self FROM standings s
    LEFT JOIN (SELECT * FROM history WHERE event = (SELECT max(event) FROM history)) h
    USING (entry_id)""")
def classic_standings(r):
    return L.classic_standings(r.standings(), r.history(), 5)


@query("""
    WITH x AS (SELECT gw AS event, max(expected_points) AS xscore FROM per_gw GROUP BY 1)
    SELECT entry_id, event AS gw, points, total_points, points_on_bench AS bench_points,
           event_transfers AS transfers, xscore, rank
    FROM history LEFT JOIN x USING (event) WHERE entry_id = 5
       OR NOT EXISTS (SELECT 1 FROM history WHERE entry_id = 5)""")
def history_curve(r):
    x = r.per_gw().groupBy("gw").agg(F.max("expected_points").alias("xscore"))
    return L.history_curve(r.history(), x, 5)


_RATINGS = """
    WITH s AS (SELECT season, gw, match_id, home_team AS club, home_team_elo AS elo, 0 AS side
               FROM matches UNION ALL
               SELECT season, gw, match_id, away_team, away_team_elo, 1 FROM matches),
    e AS (SELECT club, elo FROM (SELECT *, row_number() OVER (PARTITION BY club
              ORDER BY season DESC, gw, match_id, side) AS rn FROM s WHERE elo IS NOT NULL)
          WHERE rn = 1),
    b AS (SELECT min(elo) AS lo, max(elo) AS hi, avg(elo) AS mid FROM e),
    rat AS (SELECT club AS team_code, round((coalesce(elo, mid) - lo)
                   / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 100.0, 1) AS rating
            FROM (SELECT DISTINCT club FROM s) LEFT JOIN e USING (club), b)"""


@query(_RATINGS + " SELECT * FROM rat")
def club_ratings(r):
    return L.club_ratings(r.matches())


_FOE = """
    foe AS (SELECT team_code, gw, xdg FROM (
        SELECT x.*, rating AS xdg, row_number() OVER (PARTITION BY x.team_code, gw
                   ORDER BY side, match_id) AS rn
        FROM (SELECT gw, match_id, home_team AS team_code, away_team AS opp, 0 AS side
              FROM matches UNION ALL
              SELECT gw, match_id, away_team, home_team, 1 FROM matches) x
        JOIN rat ON rat.team_code = x.opp WHERE gw BETWEEN 11 AND 15) WHERE rn = 1)"""


@query(_RATINGS + "," + _FOE + """
    SELECT player_code, gw, xdg FROM players JOIN foe USING (team_code)""")
def difficulty(r):
    ratings = L.club_ratings(r.matches())
    return L.difficulty(r.matches(), ratings, r.players(), 11, 15)


_PRED = "(SELECT player_code, max(pts_avg_5) AS pred FROM form WHERE gw = 10 GROUP BY 1)"


@query(f"""
    SELECT player_code, {r6("coalesce(pred, ep)")} AS expected,
           CASE WHEN pred IS NOT NULL THEN 'model' ELSE 'official' END AS expected_source
    FROM (SELECT player_code, TRY_CAST(ep_next AS DOUBLE) AS ep FROM live
          WHERE TRY_CAST(ep_next AS DOUBLE) IS NOT NULL)
    FULL JOIN {_PRED} USING (player_code)""")
def expected_next(r):
    pred = r.form().where(F.col("gw") == 10).groupBy("player_code").agg(
        F.max("pts_avg_5").alias("pred"))
    return rounded(L.expected_next(r.live(), pred), "expected")


@query(_RATINGS + "," + _FOE + f""",
    fx AS (SELECT team_code, max(CASE WHEN gw = 11 THEN xdg END) AS xdg_next,
                  avg(xdg) AS xdg_next5 FROM foe GROUP BY 1),
    own AS (SELECT element, round(100.0::DOUBLE * count(DISTINCT entry_id)
            / (SELECT count(DISTINCT entry_id) FROM {_LATEST}), 1) AS own_league
            FROM {_LATEST} GROUP BY 1)
    SELECT p.player_code, p.web_name, p.position, p.team_code,
           coalesce(nullif(t.short_name, ''), t.name, '') AS team, l.status,
           TRY_CAST(l.selected_by_percent AS DOUBLE) AS selected_by_percent, xdg_next,
           {r6("xdg_next5")} AS xdg_next5, own_league, {r6("pr.pred")} AS pred_next,
           {r6("coalesce(pr.pred, TRY_CAST(l.ep_next AS DOUBLE))")} AS expected,
           CASE WHEN pr.pred IS NOT NULL THEN 'model'
                WHEN TRY_CAST(l.ep_next AS DOUBLE) IS NOT NULL THEN 'official' END
           AS expected_source
    FROM players p LEFT JOIN live l USING (player_code)
    LEFT JOIN teams t ON t.code = p.team_code LEFT JOIN fx ON fx.team_code = p.team_code
    LEFT JOIN own ON own.element = p.player_id
    LEFT JOIN {_PRED} pr ON pr.player_code = p.player_code""")
def explorer(r):
    pred = r.form().where(F.col("gw") == 10).groupBy("player_code").agg(
        F.max("pts_avg_5").alias("pred"))
    matches = r.matches()
    table = L.explorer(r.players().drop("now_cost"), r.live(), r.teams(), matches,
                       L.club_ratings(matches), r.picks(), pred, 10)
    out = table.select("player_code", "web_name", "position", "team_code", "team", "status",
                       "selected_by_percent", "xdg_next", "xdg_next5", "own_league",
                       "pred_next", "expected", "expected_source")
    return rounded(out, "xdg_next5", "pred_next", "expected")


# --- swaps ---------------------------------------------------------------------------------------

@query("""
    SELECT m.squad, m.player_code AS out_code, count(p.player_code) AS candidates
    FROM members m LEFT JOIN pool p ON p.position = m.position
         AND p.price_tenths <= m.price_tenths + 3
         AND NOT EXISTS (SELECT 1 FROM members o WHERE o.squad = m.squad
                         AND o.player_code = p.player_code)
    GROUP BY 1, 2""")
def candidate_counts(r):
    return SW.candidate_counts(r.members(), r.pool(), bank=3)


@query("""
    SELECT squad, out_code, position, out_price, candidates, in_code, in_price, CAST(rank AS INTEGER) AS rank
    FROM (SELECT m.squad, m.player_code AS out_code, m.position, m.price_tenths AS out_price,
                 p.player_code AS in_code, p.price_tenths AS in_price,
                 count(*) OVER (PARTITION BY m.squad, m.player_code) AS candidates,
                 row_number() OVER (PARTITION BY m.squad, m.player_code
                     ORDER BY coalesce(p.value, 0.0) DESC, p.player_code) AS rank
          FROM members m JOIN pool p ON p.position = m.position
               AND p.price_tenths <= m.price_tenths + 2
          WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.squad = m.squad
                            AND o.player_code = p.player_code)) WHERE rank <= 5""")
def swap_candidates(r):
    """Option lists of all squads: exact counts and the five best candidates of each member."""
    return SW.swap_options(r.members(), r.pool(), top=5, bank=2)


_BEST = f"""
    WITH cl AS (SELECT squad, team_code, count(*) AS c FROM members GROUP BY 1, 2),
    x AS (SELECT m.squad, m.player_code AS out_code, p.player_code AS in_code,
                 p.value - m.value - 4.0 AS gain
          FROM members m JOIN pool p ON p.position = m.position
               AND p.price_tenths <= m.price_tenths + 3 AND p.value - m.value - 4.0 > 0.5
          LEFT JOIN cl ON cl.squad = m.squad AND cl.team_code = p.team_code
          WHERE (p.team_code = m.team_code OR coalesce(c, 0) + 1 <= 2)
            AND NOT EXISTS (SELECT 1 FROM members o WHERE o.squad = m.squad
                            AND o.player_code = p.player_code))
    SELECT squad, out_code, in_code, {r6("gain")} AS gain FROM (
        SELECT *, row_number() OVER (PARTITION BY squad ORDER BY round(gain, 9) DESC, out_code,
                                     in_code) AS rn FROM x) WHERE rn = 1"""


@query(_BEST)
def best_swap(r):
    out = SW.best_swaps(r.members(), r.pool(), bank=3, free_transfers=0, min_gain=0.5, **SWAP)
    return rounded(out, "gain")


def _pick(f, i: int) -> str:
    return f"{('gkp', 'def', 'mid', 'fwd')[i]}[:{f[i]}]"


def _formation_sql(f) -> str:
    """Score of a formation and the same with its best starter twice, null if it does not fit."""
    lists = [("gkp", "def", "mid", "fwd")[i] for i in range(4) if f[i]]
    fits = " AND ".join(f"len({('gkp', 'def', 'mid', 'fwd')[i]}) >= {f[i]}" for i in range(4) if f[i])
    score = " + ".join(f"list_sum({_pick(f, i)})" for i in range(4) if f[i])
    star = ", ".join(f"{n}[1]" for n in lists)
    return f"CASE WHEN {fits} THEN {{'s': {score}, 't': {score} + greatest({star})}} END"


def _even(c: str) -> str:
    """Four decimals rounded to three, an exact half to the even side."""
    m = f"CAST(round({c} * 10000) AS BIGINT)"
    return (f"({m} // 10 + CASE WHEN {m} % 10 > 5 OR ({m} % 10 = 5 AND ({m} // 10) % 2 = 1)"
            f" THEN 1 ELSE 0 END) / 1000.0")


_PLAN = f"""
    WITH own AS (SELECT element AS player_code, count(DISTINCT entry_id)
                     / (SELECT count(DISTINCT entry_id) FROM picks) AS own FROM picks GROUP BY 1),
    w AS (SELECT pool.* EXCLUDE (value), value AS model, own, value * (1.0 - coalesce(own, 0.0)) AS v,
                 value * 0.5 AS ep FROM pool LEFT JOIN own USING (player_code)),
    ms AS (SELECT m.squad, w.* FROM members m JOIN w USING (player_code)),
    sell AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY model, player_code)
                 AS rk, count(*) OVER (PARTITION BY squad) AS n FROM ms) WHERE rk <= ceil(n * 0.4)),
    cl AS (SELECT squad, team_code, count(*) AS c FROM ms GROUP BY 1, 2),
    moves AS (SELECT * FROM (
        SELECT s.squad, s.player_code AS o, p.player_code AS i, s.position, s.v AS vo, p.v AS vi,
               row_number() OVER (PARTITION BY s.squad, s.player_code ORDER BY p.v DESC, p.player_code) AS rk
        FROM sell s JOIN w p ON p.position = s.position AND p.price_tenths <= s.price_tenths + 3
        LEFT JOIN cl ON cl.squad = s.squad AND cl.team_code = p.team_code
        WHERE (p.team_code = s.team_code OR coalesce(c, 0) + 1 <= 2)
          AND NOT EXISTS (SELECT 1 FROM ms x WHERE x.squad = s.squad AND x.player_code = p.player_code))
        WHERE rk <= 10),
    opt AS (SELECT DISTINCT squad, NULL::BIGINT AS o, NULL::BIGINT AS i, NULL AS position,
                   NULL::DOUBLE AS vo, NULL::DOUBLE AS vi FROM ms
            UNION ALL SELECT squad, o, i, position, vo, vi FROM moves),
    planned AS (SELECT t.squad, t.o, t.i, t.vi, m.player_code, m.position, m.team_code, m.v
                FROM opt t JOIN ms m ON m.squad = t.squad AND m.player_code IS DISTINCT FROM t.o
                UNION ALL SELECT t.squad, t.o, t.i, t.vi, w.player_code, w.position, w.team_code, w.v
                FROM opt t JOIN w ON w.player_code = t.i),
    lists AS (SELECT squad, o, i, any_value(vi) AS vi, {", ".join(
        f"coalesce(list(v ORDER BY v DESC) FILTER (position = '{p}'), []) AS {p.lower()}"
        for p in ("GKP", "DEF", "MID", "FWD"))} FROM planned GROUP BY 1, 2, 3),
    rated AS (SELECT squad, o, i, vi, round_even(list_sort(list_filter(
                   [{", ".join(_formation_sql(f) for f in FORMATIONS)}],
                   lambda z: z IS NOT NULL), 'DESC')[1].t, 3) AS score FROM lists),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY score DESC, o IS NOT NULL,
                   vi DESC NULLS LAST, o, i) AS rank FROM rated WHERE score IS NOT NULL),
    best AS (SELECT r.*, h.score AS hold FROM ranked r JOIN rated h ON h.squad = r.squad
             AND h.o IS NULL WHERE rank <= 10),
    kk AS (SELECT p.*, b.rank, row_number() OVER (PARTITION BY b.squad, b.rank, p.position
               ORDER BY v DESC, p.player_code) AS rk
           FROM planned p JOIN best b ON b.squad = p.squad AND b.o IS NOT DISTINCT FROM p.o
                AND b.i IS NOT DISTINCT FROM p.i),
    f(n, g, d, m, a) AS (VALUES {_FORMATION_ROWS}),
    sums AS (SELECT squad, rank, n, g, d, m, a, sum(v) AS score, count(*) AS k
             FROM kk JOIN f ON rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d
                                     WHEN 'MID' THEN m ELSE a END GROUP BY ALL),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY squad, rank
                 ORDER BY round(score, 9) DESC, n) AS place FROM sums WHERE k = 4) WHERE place = 1),
    placed AS (SELECT kk.*, rk <= CASE position WHEN 'GKP' THEN g WHEN 'DEF' THEN d
                   WHEN 'MID' THEN m ELSE a END AS starts FROM kk JOIN chosen USING (squad, rank)),
    stars AS (SELECT *, row_number() OVER (PARTITION BY squad, rank ORDER BY v DESC, player_code) AS z
              FROM placed WHERE starts),
    cap AS (SELECT squad, rank, player_code AS captain, team_code AS club FROM stars WHERE z = 1),
    vice AS (SELECT s.squad, s.rank, coalesce(
                 min_by(s.player_code, z) FILTER (s.team_code IS DISTINCT FROM club),
                 max(s.player_code) FILTER (z = 2)) AS vice
             FROM stars s JOIN cap USING (squad, rank) GROUP BY 1, 2),
    q AS (SELECT player_code, list_transform(vector, lambda x: floor(x)) AS vector FROM vectors),
    shape AS (SELECT s.squad, s.rank, bool_and(vector IS NOT NULL) AS ok, [{", ".join(
        f"sum(vector[{k}] * CASE WHEN z = 1 THEN 2 ELSE 1 END)" for k in range(1, 10))}] AS xi,
        list(s.player_code ORDER BY s.player_code) AS starters
        FROM stars s LEFT JOIN q USING (player_code) GROUP BY 1, 2),
    bench AS (SELECT squad, rank, list(player_code ORDER BY position <> 'GKP', v DESC, player_code) AS bench
              FROM placed WHERE NOT starts GROUP BY 1, 2),
    held AS (SELECT b.squad, xi AS hxi, ok AS hok FROM best b JOIN shape USING (squad, rank) WHERE o IS NULL)
    SELECT b.squad, CAST(b.rank AS INTEGER) AS rank, o AS transfer_out_code, i AS transfer_in_code,
           x.web_name AS transfer_out, y.web_name AS transfer_in, score AS expected_score,
           round_even(score - hold, 3) AS expected_delta,
           CASE WHEN o IS NOT NULL THEN round_even(coalesce(x.own, 0.0), 3) END AS ownership_out,
           CASE WHEN i IS NOT NULL THEN round_even(coalesce(y.own, 0.0), 3) END AS ownership_in,
           {_even("x.model")} AS model_expected_out, {_even("y.model")} AS model_expected_in,
           x.ep AS official_ep_next_out, y.ep AS official_ep_next_in, captain, vice AS vice_captain,
           array_to_string(starters, ',') AS starters, coalesce(array_to_string(bench, ','), '') AS bench,
           CASE WHEN ok THEN xi[3] END AS xi_q10, CASE WHEN ok THEN xi[5] END AS xi_q50,
           CASE WHEN ok THEN xi[7] END AS xi_q90,
           CASE WHEN ok AND hok THEN round_even(list_sum(list_transform(range(0, 81), lambda c:
               CASE WHEN xi[c // 9 + 1] > hxi[c % 9 + 1] THEN 1.0 WHEN xi[c // 9 + 1] = hxi[c % 9 + 1]
               THEN 0.5 ELSE 0.0 END)) / 81.0, 4) END AS prob_beat_hold
    FROM best b JOIN shape USING (squad, rank) JOIN cap USING (squad, rank) JOIN vice USING (squad, rank)
    LEFT JOIN bench USING (squad, rank) LEFT JOIN held ON held.squad = b.squad
    LEFT JOIN w x ON x.player_code = o LEFT JOIN w y ON y.player_code = i"""


@query(_PLAN)
def week_plan(r):
    """Plans of every squad, ten each, with line-up, bench and distribution."""
    picks = stored(r.picks().select("entry_id", "gw", "element", "position"), "plan-picks")
    plain = stored(r.pool(), "plan-parts")
    pool = plain.withColumn("ep_next", F.col("value") * 0.5)
    own = L.ownership_all(picks).withColumnRenamed("element", "player_code")
    vectors = r.vectors().withColumn("vector", F.transform(
        "vector", lambda v: F.floor(v).cast("double")))
    out = SW.week_plan(r.members(picks, plain), pool, own, vectors, bank=3, formations=FORMATIONS, **SWAP)
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select(
        "squad", "rank", "transfer_out_code", "transfer_in_code", "transfer_out", "transfer_in",
        "expected_score", "expected_delta", "ownership_out", "ownership_in",
        "model_expected_out", "model_expected_in", "official_ep_next_out",
        "official_ep_next_in", "captain", "vice_captain", text("starters"), text("bench"),
        "xi_q10", "xi_q50", "xi_q90", "prob_beat_hold")



@query("""
    SELECT squad, player_code, coalesce(s.now_cost, l.now_cost) AS price_tenths
    FROM members m LEFT JOIN (SELECT player_code, price_tenths + 1 AS now_cost FROM elements) l
    USING (player_code)
    LEFT JOIN (SELECT player_code, price_tenths AS now_cost FROM elements
               WHERE player_code % 3 = 0) s USING (player_code)""")
def current_prices(r):
    base = r.elements().select(F.col("player_code").alias("player_id"), "price_tenths")
    live = base.select("player_id", (F.col("price_tenths") + 1).alias("now_cost"))
    frozen = base.where(F.col("player_id") % 3 == 0).select(
        "player_id", F.col("price_tenths").alias("now_cost"))
    picks = r.members().select("squad", "player_code",
                               F.col("player_code").alias("player_id"))
    return SQ.current_prices(picks, live, frozen).select("squad", "player_code",
                                                         "price_tenths")


@query("""
    SELECT squad, player_code, CASE WHEN value IS NULL THEN 0.0 ELSE
           round(value * (1.0 - coalesce(own, 0.0)), 6) + 0.0 END AS value
    FROM members LEFT JOIN (SELECT element AS player_code, count(DISTINCT entry_id)
        / (SELECT count(DISTINCT entry_id) FROM picks) AS own FROM picks GROUP BY 1)
    USING (player_code)""")
def discounted_values(r):
    own = L.ownership_all(r.picks()).withColumnRenamed("element", "player_code")
    out = r.members().join(own, "player_code", "left").select(
        "squad", "player_code", X.ownership_discounted("value", "ownership").alias("value"))
    return rounded(out, "value")


@query("""
    SELECT player_code, CASE element_type WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID'
           ELSE 'FWD' END AS position, CAST(element_type AS INTEGER) AS place,
           TRY_CAST(selected_by_percent AS DOUBLE) AS selected
    FROM live""")
def element_types(r):
    position = X.position_of_element_type("element_type")
    return r.live().select("player_code", position.alias("position"),
                           X.position_order(position).cast("int").alias("place"),
                           X.lenient_double("selected_by_percent").alias("selected"))


@query("""
    SELECT p.player_id, p.team_code IS NOT DISTINCT FROM l.team_code AS same_club,
           CAST(round_even(p.now_cost * 10.0, 0) AS BIGINT) IS NOT DISTINCT FROM l.now_cost
           AS same_price
    FROM players p JOIN live l USING (player_code)""")
def unchanged(r):
    live = r.live().select("player_code", F.col("team_code").alias("live_team"),
                           F.col("now_cost").alias("live_cost"))
    return r.players().join(live, "player_code").select(
        "player_id", X.unchanged("team_code", "live_team").alias("same_club"),
        X.unchanged(X.to_tenths("now_cost"), "live_cost").alias("same_price"))
