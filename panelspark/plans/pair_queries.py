"""Head-to-head, co-movement and quantile-vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import quantiles as Q
from panelspark.functions import scalar as X
from panelspark.operators import cooccur as CO
from panelspark.operators import h2h as H
from panelspark.operators import panel as P
from panelspark.operators import sketches as SK
from panelspark.plans.registry import query, rounded, rounded_vector
from panelspark.plans.roles_sql import corr_sql, r6


def _poly(x: str, coefficients) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({x} * {out} + {c})"
    return out


def phi_sql(x: str) -> str:
    """Normal distribution function of a column, in SQL."""
    a = f"abs({x})"
    body = (f"exp(-{a} * {a} / 2.0) * {_poly(a, X.NORMAL_NUMERATOR)} "
            f"/ {_poly(a, X.NORMAL_DENOMINATOR)}")
    tail = (f"exp(-{a} * {a} / 2.0) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / "
            f"({a} + 4.0 / ({a} + 0.65))))) / {X.SQRT_TWO_PI}")
    upper = f"(CASE WHEN {a} < {X.TAIL_START} THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {upper} ELSE {upper} END)"


def phi_series_sql(z: str, terms: int = 120) -> str:
    """The same from its power series, without the engine's coefficients: 1/2 + phi(z) times the
    sum of z^(2k+1) / (1 * 3 * ... * (2k+1)); certain beyond 8.3 standard deviations."""
    total = "1.0"
    for k in range(terms, 0, -1):
        total = f"(1.0 + {z} * {z} / {2 * k + 1}.0 * {total})"
    upper = f"(0.5 + exp(-{z} * {z} / 2.0) / sqrt(2.0 * pi()) * {z} * {total})"
    return f"(CASE WHEN {z} > 8.3 THEN 1.0 WHEN {z} < -8.3 THEN 0.0 ELSE {upper} END)"


# --- squads against squads ---------------------------------------------------------

@query(f"""
    SELECT team_id, gw, {r6("sum(expected_points)")} AS gw_total, count(*) AS n_players
    FROM basket JOIN per_gw USING (player_code) GROUP BY 1, 2""")
def team_totals(r):
    return rounded(H.squad_gw_totals(r.basket(), r.per_gw()), "gw_total")


@query(f"""
    SELECT a.team_id, count(*) AS played,
           count(*) FILTER (a.gw_total > b.gw_total) AS wins,
           count(*) FILTER (a.gw_total < b.gw_total) AS losses,
           count(*) FILTER (a.gw_total = b.gw_total) AS draws,
           {r6("avg(a.gw_total - b.gw_total)")} AS avg_edge,
           {r6("stddev_samp(a.gw_total - b.gw_total)")} AS edge_std,
           {r6('''(count(*) FILTER (a.gw_total > b.gw_total)
                + 0.5 * count(*) FILTER (a.gw_total = b.gw_total)) / count(*)''')} AS win_ratio
    FROM month_totals a JOIN month_totals b ON a.gw = b.gw AND a.team_id <> b.team_id
    GROUP BY 1""")
def h2h_record(r):
    return rounded(H.round_robin(r.month_totals()), "avg_edge", "edge_std", "win_ratio")


_Z = "((a.sample_mean - b.sample_mean) / nullif(sqrt(a.sample_std * a.sample_std" \
     " + b.sample_std * b.sample_std), 0))"


@query(f"""
    WITH z AS (SELECT a.team_id, a.sample_mean - b.sample_mean AS d, {_Z} AS z
               FROM squad_dist a JOIN squad_dist b
               ON a.gw = b.gw AND a.team_id <> b.team_id),
    p AS (SELECT team_id, d, CASE WHEN z IS NULL THEN CASE WHEN d = 0 THEN 0.5
                 WHEN d > 0 THEN 1.0 ELSE 0.0 END ELSE {phi_series_sql("z")} END AS p FROM z)
    SELECT team_id, count(*) AS played, {r6("sum(p)")} AS exp_wins, {r6("avg(d)")} AS avg_edge,
           {r6("sum(p) / count(*)")} AS win_ratio FROM p GROUP BY 1""")
def h2h_dist(r):
    return rounded(H.expected_record(r.squad_dist()), "exp_wins", "avg_edge", "win_ratio")


@query(f"""
    WITH t AS (SELECT team_id, gw, {r6("sum(expected_points)")} AS gw_total
               FROM basket JOIN per_gw USING (player_code) GROUP BY 1, 2),
    w AS (SELECT team_id, sum(gw_total) AS window_total, min(gw_total) AS worst_gw_total
          FROM t GROUP BY 1),
    g AS (SELECT team_id, gw AS worst_gw FROM (SELECT *, row_number() OVER (
              PARTITION BY team_id ORDER BY gw_total, gw) AS rn FROM t) WHERE rn = 1),
    s AS (SELECT team_id, max(expected_total) / sum(expected_total) AS sd
          FROM basket GROUP BY 1)
    SELECT team_id, {r6("window_total")} AS window_total, worst_gw, worst_gw_total,
           {r6("sd")} AS star_dependence
    FROM w JOIN g USING (team_id) JOIN s USING (team_id)""")
def weaknesses(r):
    totals = rounded(H.squad_gw_totals(r.basket(), r.per_gw()), "gw_total")
    return rounded(H.weaknesses(r.basket(), totals), "window_total", "star_dependence")


@query("""
    SELECT team_id, round(gw_total, 6) AS gw_total FROM (
        SELECT team_id, sum(gw_total) AS gw_total FROM month_totals GROUP BY 1)
    ORDER BY gw_total DESC, team_id LIMIT 1""")
def best_team(r):
    totals = r.month_totals().groupBy("team_id").agg(F.sum("gw_total").alias("gw_total"))
    return rounded(H.best_team(totals, "gw_total"), "gw_total")


@query("""
    SELECT count(*) AS distinct_squads FROM (SELECT DISTINCT m FROM (
        SELECT team_id, list(DISTINCT player_code ORDER BY player_code) AS m
        FROM (SELECT l_orderkey AS team_id, l_partkey % 50 AS player_code FROM lineitem)
        GROUP BY 1))""")
def distinct_squads(r):
    return H.distinct_squads(r.t("lineitem").select(
        F.col("l_orderkey").alias("team_id"),
        (F.col("l_partkey") % 50).alias("player_code")))


# --- with and without, pair covariances ---------------------------------------------

@query(f"""
    WITH focal AS (SELECT * FROM form WHERE player_id =
                       (SELECT max_by(user_id, (c, -user_id)) FROM
                        (SELECT user_id, count(*) AS c FROM events GROUP BY 1))),
    other AS (SELECT DISTINCT gw FROM form WHERE player_id = (SELECT min(user_id) FROM events)),
    f AS (SELECT total_points, gw IN (SELECT gw FROM other) AS w FROM focal)
    SELECT CASE WHEN w THEN 'with' ELSE 'without' END AS grp, count(*) AS n,
           {r6("avg(total_points)")} AS mean FROM f GROUP BY 1
    UNION ALL SELECT 'overall', count(*), {r6("avg(total_points)")} FROM f""")
def with_without(r):
    events = r.t("events")
    busiest = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.max_by("user_id", F.struct("c", -F.col("user_id")))).scalar()
    first = events.agg(F.min("user_id")).scalar()
    out = CO.with_without(r.form().where(F.col("player_id") == busiest),
                          r.form().where(F.col("player_id") == first), ["gw"])
    return rounded(out, "mean")


@query(f"""
    SELECT count(*) AS pairs, {r6("avg(a.resid * b.resid)")} AS mean_product
    FROM residuals a JOIN residuals b
    ON a.gw = b.gw AND a.team_code = b.team_code AND a.player_code < b.player_code""")
def pair_cov_same(r):
    return rounded(CO.same_group_products(r.residuals()), "mean_product")


@query(f"""
    SELECT count(*) AS pairs, {r6("avg(a.resid * b.resid)")} AS mean_product
    FROM residuals a JOIN residuals b
    ON a.gw = b.gw AND a.opponent_team_code = b.team_code
       AND a.team_code = b.opponent_team_code AND a.player_code < b.player_code""")
def pair_cov_opponent(r):
    return rounded(CO.opponent_products(r.residuals()), "mean_product")


@query(f"""
    WITH a AS (SELECT avg(a.resid * b.resid) AS v FROM residuals a JOIN residuals b
        ON a.gw = b.gw AND a.team_code = b.team_code AND a.player_code < b.player_code),
    b AS (SELECT avg(a.resid * b.resid) AS v FROM residuals a JOIN residuals b
        ON a.gw = b.gw AND a.opponent_team_code = b.team_code
           AND a.team_code = b.opponent_team_code AND a.player_code < b.player_code),
    p AS (SELECT var_samp(resid) AS v FROM residuals)
    SELECT {r6("p.v")} AS pooled, {r6("a.v")} AS alpha, {r6("b.v")} AS beta,
           {r6("least(greatest(a.v / p.v, 0), 0.25)")} AS rho FROM a, b, p""")
def residual_structure(r):
    return rounded(CO.residual_structure(r.residuals()), "pooled", "alpha", "beta", "rho")


@query(f"""
    SELECT player_code, {r6('''coalesce(var_samp(resid),
           (SELECT var_samp(resid) FROM residuals))''')} AS sig2
    FROM residuals GROUP BY 1""")
def entity_variance(r):
    return rounded(CO.entity_variance(r.residuals()), "sig2")


@query(f"""
    WITH lineup AS (
        SELECT entry_id AS squad, gw, player_code, team_code, points AS actual,
               coalesce(expected_points, 0.0) AS expected
        FROM squad_picks LEFT JOIN per_gw USING (player_code, gw)),
    met AS (SELECT DISTINCT year(o_orderdate) AS gw,
                   least(o_custkey % 25, o_orderkey % 25) + 1 AS a,
                   greatest(o_custkey % 25, o_orderkey % 25) + 1 AS b
            FROM orders),
    var AS (SELECT player_code, coalesce(var_samp(resid),
                (SELECT var_samp(resid) FROM residuals)) AS sig2 FROM residuals GROUP BY 1),
    alpha AS (SELECT avg(a.resid * b.resid) AS alpha FROM residuals a JOIN residuals b
        ON a.gw = b.gw AND a.team_code = b.team_code AND a.player_code < b.player_code),
    beta AS (SELECT avg(a.resid * b.resid) AS beta FROM residuals a JOIN residuals b
        ON a.gw = b.gw AND a.opponent_team_code = b.team_code
           AND a.team_code = b.opponent_team_code AND a.player_code < b.player_code),
    pairs AS (SELECT x.squad, x.gw, count(*) FILTER (x.team_code = y.team_code) AS same,
                     count(*) FILTER (EXISTS (SELECT 1 FROM met WHERE met.gw = x.gw
                         AND a = least(x.team_code, y.team_code)
                         AND b = greatest(x.team_code, y.team_code))) AS opp
              FROM lineup x JOIN lineup y ON x.squad = y.squad AND x.gw = y.gw
                   AND x.player_code < y.player_code GROUP BY 1, 2),
    base AS (SELECT squad, gw, sum(expected) AS e, sum(actual) AS act,
                    sum(coalesce(sig2, (SELECT var_samp(resid) FROM residuals))) AS v
             FROM lineup LEFT JOIN var USING (player_code) GROUP BY 1, 2),
    full_rows AS (SELECT base.*, coalesce(same, 0) AS same, coalesce(opp, 0) AS opp,
                    v + 2 * alpha * coalesce(same, 0) - 2 * beta * coalesce(opp, 0) AS vc
                  FROM base LEFT JOIN pairs USING (squad, gw) CROSS JOIN alpha CROSS JOIN beta)
    SELECT squad, gw, same, opp, {r6("vc")} AS var_cov, {r6("(act - e) / sqrt(v)")} AS z_iid,
           {r6("(act - e) / sqrt(vc)")} AS z_cov
    FROM full_rows WHERE v > 1e-9 AND vc > 1e-9""")
def squad_variance(r):
    members = (r.squad_picks().join(r.per_gw(), ["player_code", "gw"], "left")
               .select(F.col("entry_id").alias("squad"), "gw", "player_code", "team_code",
                       F.coalesce("expected_points", F.lit(0.0)).alias("expected"),
                       F.col("points").alias("actual")))
    structure = CO.residual_structure(r.residuals())
    variance = CO.entity_variance(r.residuals())
    matches = r.t("orders").select(
        F.year("o_orderdate").cast("bigint").alias("gw"),
        (F.col("o_custkey") % 25 + 1).alias("home_team"),
        (F.col("o_orderkey") % 25 + 1).alias("away_team"))
    out = CO.squad_variance(members, variance, matches, structure).select(
        "squad", "gw", "same", "opp", "var_cov", "z_iid", "z_cov")
    return rounded(out, "var_cov", "z_iid", "z_cov")


# --- correlations ----------------------------------------------------------------------

DRIVERS = ("was_home", "home_elo", "opponent_elo", "prev_points", "pts_avg_3", "pts_avg_5")


def _num(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


@query("\n UNION ALL ".join(
    f"SELECT '{d}' AS feature, {corr_sql('next_points', _num(d))} AS r FROM features"
    for d in DRIVERS))
def driver_corr(r):
    return rounded(CO.driver_correlations(r.features(), DRIVERS, "next_points"), "r")


@query("SELECT position, " + ", ".join(
    f"{corr_sql('next_points', _num(d))} AS {d}" for d in DRIVERS)
    + " FROM features JOIN (SELECT player_code, position FROM players) USING (player_code)"
      " GROUP BY 1")
def driver_corr_by_position(r):
    rows = r.features().join(r.players().select("player_code", "position"), "player_code")
    return rounded(CO.driver_correlations_wide(rows, DRIVERS, "next_points", "position"),
                   *DRIVERS)


def _collinearity_cell(a: str, b: str) -> str:
    r = "1.0::DOUBLE" if a == b else corr_sql(_num(a), _num(b))
    return f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM features HAVING count(*) > 0"


@query("\n UNION ALL ".join(_collinearity_cell(a, b) for a in DRIVERS for b in DRIVERS))
def collinearity(r):
    return rounded(CO.collinearity(r.features(), DRIVERS), "r")


@query(f"""
    WITH qual AS (SELECT player_code, team_code FROM panel JOIN players USING (player_id)
                  WHERE minutes > 0 GROUP BY 1, 2 HAVING count(*) >= 8),
    g AS (SELECT player_code, q.team_code, gw, total_points FROM form
          JOIN qual q USING (player_code)),
    dense AS (SELECT e.player_code, e.team_code, t.gw, coalesce(g.total_points, 0.0) AS x
              FROM (SELECT DISTINCT player_code, team_code FROM g) e
              CROSS JOIN (SELECT DISTINCT gw FROM g) t
              LEFT JOIN g ON g.player_code = e.player_code AND g.gw = t.gw),
    big AS (SELECT team_code FROM (SELECT DISTINCT player_code, team_code FROM g)
            GROUP BY 1 HAVING count(*) >= 3),
    c AS (SELECT a.player_code AS pa, b.player_code AS pb, a.team_code AS ta,
                 b.team_code AS tb, corr(a.x, b.x) AS r
          FROM dense a JOIN dense b ON a.gw = b.gw AND a.player_code < b.player_code
          GROUP BY 1, 2, 3, 4)
    SELECT count(*) FILTER (ta = tb AND ta IN (FROM big)) AS same_pairs,
           {r6("avg(r) FILTER (ta = tb AND ta IN (FROM big))")} AS same_mean_r,
           count(*) FILTER (ta <> tb) AS cross_pairs,
           {r6("avg(r) FILTER (ta <> tb)")} AS cross_mean_r
    FROM c WHERE r IS NOT NULL AND isfinite(r)""")
def entity_pair_corr(r):
    played = r.panel().where(F.col("minutes") > 0).join(
        r.players().select("player_id", "player_code", "team_code"), "player_id")
    qualified = played.groupBy("player_code", "team_code").agg(
        F.count(F.lit(1)).alias("games")).where(F.col("games") >= 8).drop("games")
    grid = r.form().select("player_code", "gw", "total_points")
    return rounded(CO.entity_pair_correlation(grid, qualified), "same_mean_r", "cross_mean_r")


@query(f"""
    SELECT position, {r6("avg(total_points)")} AS mean, count(total_points) AS played_gw
    FROM panel JOIN players USING (player_id) WHERE minutes > 0 GROUP BY 1""")
def position_baselines(r):
    return rounded(CO.position_baselines(r.panel(), r.players()), "mean")


@query(f"""
    WITH f AS (SELECT position, next_points, opponent_elo FROM features
               JOIN (SELECT player_code, position FROM players) USING (player_code)),
    c AS (SELECT quantile_cont(opponent_elo, 0.25) AS a, quantile_cont(opponent_elo, 0.5) AS b,
                 quantile_cont(opponent_elo, 0.75) AS d FROM f)
    SELECT position, CASE WHEN opponent_elo < a THEN 1 WHEN opponent_elo < b THEN 2
                          WHEN opponent_elo < d THEN 3 ELSE 4 END AS opp_q,
           {r6("avg(next_points)")} AS mean_pts, count(next_points) AS n
    FROM f, c GROUP BY 1, 2""")
def quartile_matchup(r):
    rows = r.features().join(r.players().select("player_code", "position"), "player_code")
    return rounded(CO.quartile_table(rows, "opponent_elo", "next_points"),
                   "mean_pts")


@query(f"""
    SELECT position, was_home, {r6("avg(next_points)")} AS mean_pts FROM features
    JOIN (SELECT player_code, position FROM players) USING (player_code) GROUP BY 1, 2""")
def venue_matchup(r):
    rows = r.features().join(r.players().select("player_code", "position"), "player_code")
    return rounded(CO.venue_table(rows, "next_points"), "mean_pts")


@query(f"""
    WITH pt AS (SELECT p.player_id, p.gw, total_points, team_code, position FROM panel p
                JOIN players USING (player_id) WHERE minutes > 0),
    own AS (SELECT team_code, gw, sum(total_points) AS own_total FROM pt GROUP BY 1, 2),
    dat AS (SELECT pt.position, total_points, o.own_total, r.own_total AS opp_total
            FROM pt JOIN own o USING (team_code, gw)
            JOIN sides s ON s.team_code = pt.team_code AND s.gw = pt.gw
            JOIN own r ON r.team_code = s.opponent_team_code AND r.gw = s.gw)
    SELECT 'overall' AS scope, {corr_sql("total_points", "own_total")} AS vs_own_team,
           {corr_sql("total_points", "opp_total")} AS vs_opponent FROM dat
    UNION ALL SELECT position, {corr_sql("total_points", "own_total")},
           {corr_sql("total_points", "opp_total")} FROM dat GROUP BY 1""")
def shared_fixture_corr(r):
    return rounded(CO.shared_fixture_correlations(r.panel(), r.players(), r.matches()),
                   "vs_own_team", "vs_opponent")


@query(f"""
    WITH own AS (SELECT team_code, gw, sum(total_points) AS t FROM panel
                 JOIN players USING (player_id) WHERE minutes > 0 GROUP BY 1, 2)
    SELECT {corr_sql("h.t", "a.t")} AS r, count(*) AS n FROM matches m
    JOIN own h ON h.team_code = home_team AND h.gw = m.gw
    JOIN own a ON a.team_code = away_team AND a.gw = m.gw""")
def match_total_corr(r):
    return rounded(CO.match_total_correlation(r.panel(), r.players(), r.matches()), "r")


@query(f"""
    WITH own AS (SELECT p.player_id, p.gw, total_points, team_code, position FROM panel p
                 JOIN players USING (player_id) WHERE minutes > 0),
    tot AS (SELECT team_code, gw, sum(total_points) AS own_total FROM own GROUP BY 1, 2),
    m AS (SELECT gw, team_code, opponent_team_code FROM fixtures),
    side AS (SELECT gw, team_code, opponent_team_code FROM m
             UNION ALL SELECT gw, opponent_team_code, team_code FROM m)
    SELECT o.player_id, o.gw, {r6("t.own_total")} AS own_total,
           {r6("q.own_total")} AS opp_total
    FROM own o JOIN tot t USING (team_code, gw)
    JOIN side s ON s.team_code = o.team_code AND s.gw = o.gw
    JOIN tot q ON q.team_code = s.opponent_team_code AND q.gw = s.gw""")
def team_context(r):
    one = P.fixture_context(r.matches()).select(
        "gw", F.col("team_code").alias("home_team"),
        F.col("opponent_team_code").alias("away_team"))
    out = CO.with_team_totals(r.panel(), r.players(), one).select(
        "player_id", "gw", "own_total", "opp_total")
    return rounded(out, "own_total", "opp_total")


def _whole_points(r):
    return r.panel().withColumn("total_points", F.floor("total_points"))


_STATE = """
    SELECT {keys}, floor(total_points) AS total_points
    FROM panel JOIN players USING (player_id)
    JOIN (SELECT gw, team_code, least(goals, 4) AS own_bin, least(conceded, 3) AS conceded_bin
          FROM sides WHERE goals IS NOT NULL AND conceded IS NOT NULL) USING (gw, team_code)"""


def _state_sql(keys: str) -> str:
    on = " AND ".join(f"c.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH st AS ({_STATE.format(keys=keys)}),
    s AS (SELECT {keys}, count(*) AS state_n, avg(total_points) AS state_mean FROM st
          GROUP BY {keys}),
    c AS (SELECT {keys}, CAST(total_points AS BIGINT) AS total_points, count(*) AS n FROM st
          GROUP BY {keys}, total_points)
    SELECT {picked}, total_points, n, state_n, {r6("state_mean")} AS state_mean
    FROM c JOIN s ON {on}"""


@query(_state_sql("position, own_bin, conceded_bin"))
def outcomes_by_state(r):
    return rounded(CO.outcome_tables(_whole_points(r), r.players(), r.matches())[0],
                   "state_mean")


@query(_state_sql("player_code"))
def outcomes_by_entity(r):
    return rounded(CO.outcome_tables(_whole_points(r), r.players(), r.matches())[1],
                   "state_mean")


@query("""SELECT home_score, away_score, count(*) AS n FROM matches
          WHERE finished AND home_score IS NOT NULL AND away_score IS NOT NULL GROUP BY 1, 2""")
def goal_states(r):
    return CO.goal_states(r.matches())


@query("WITH q AS (SELECT quantile_cont(gw_total, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95,"
       " 0.99]) AS v, avg(gw_total) AS m, stddev_pop(gw_total) AS s,"
       " avg(CASE WHEN gw_total >= 200 THEN 1.0 ELSE 0.0 END) AS p FROM month_totals)\n"
       + "\n UNION ALL ".join(
           f"SELECT '{n}' AS stat, {r6(e)} AS value FROM q" for n, e in [
               ("mean", "m"), ("std", "s"),
               *[(n, f"v[{i + 1}]") for i, n in enumerate(S.Q_NAMES_PADDED)],
               ("p_ge_200", "p")]))
def sampling_summary(r):
    out = CO.sampling_summary(r.month_totals(), "gw_total", S.QS, S.Q_NAMES_PADDED,
                              (200,))
    return rounded(out, "value")


@query(f"""
    WITH b AS (SELECT min(gw_total) AS lo, max(gw_total) AS hi FROM month_totals),
    c AS (SELECT CAST(least(floor((gw_total - lo) * 24 / (hi - lo)), 23) AS INTEGER) AS bin,
                 count(*) AS n FROM month_totals, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, {r6("lo + i * ((hi - lo) / 24)")} AS low,
           {r6("lo + (i + 1) * ((hi - lo) / 24)")} AS high, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(0, 24)) AS i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def histogram(r):
    return rounded(CO.histogram(r.month_totals(), "gw_total"), "low", "high")


# --- quantile vectors -----------------------------------------------------------------

_LABELS = [f"v{i}" for i in range(9)]
_VECTOR_COLUMNS = ", ".join(f"{r6(f'vector[{i + 1}]')} AS v{i}" for i in range(9))


@query(f"SELECT player_code, {_VECTOR_COLUMNS} FROM vectors")
def quantile_vectors(r):
    return rounded_vector(r.vectors(), "vector", "player_code", labels=_LABELS)


_KNOTS = "[0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]"
_PAD = "[vector[1]] || vector || [vector[9]]"
_MEAN = ("(SELECT sum((k[i + 1] - k[i]) * (p[i] + p[i + 1]) / 2) "
         "FROM (SELECT unnest(range(1, 11)) AS i))")


@query(f"""
    WITH w AS (SELECT player_code, list_transform(vector, lambda x: x / 991.7320413) AS vector
               FROM vectors),
    v AS (SELECT player_code, {_PAD} AS p, {_KNOTS} AS k FROM w),
    m AS (SELECT *, {_MEAN} AS m FROM v)
    SELECT player_code, {r6("m")} AS mean, {r6('''sqrt((SELECT sum((k[i + 1] - k[i])
           * ((p[i] - m) ** 2 + (p[i + 1] - m) ** 2) / 2)
           FROM (SELECT unnest(range(1, 11)) AS i)))''')} AS std
    FROM m""")
def quantile_moments(r):
    vectors = r.vectors().withColumn(
        "vector", F.transform("vector", lambda x: x / 991.7320413))
    out = vectors.select("player_code", Q.mean("vector").alias("mean"),
                         Q.std("vector").alias("std"))
    return rounded(out, "mean", "std")


def _below_sql(t: str) -> str:
    """P(X < t) of ``vector`` by counting values up to t (values are ascending)."""
    qs = "[0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]"
    k = f"len(list_filter(vector, lambda x: x <= {t}))"
    return (f"(CASE WHEN {t} <= vector[1] THEN 0.0 WHEN {t} >= vector[9] THEN 1.0 ELSE "
            f"{qs}[{k}] + ({t} - vector[{k}]) / (vector[{k} + 1] - vector[{k}]) "
            f"* ({qs}[{k} + 1] - {qs}[{k}]) END)")


@query(f"""
    SELECT player_code, {r6(_below_sql("20000.0"))} AS p20, {r6(_below_sql("50000.0"))} AS p50,
           {r6(_below_sql("90000.0"))} AS p90 FROM vectors""")
def prob_below(r):
    out = r.vectors().select("player_code", *[
        Q.probability_below("vector", float(t) * 1000).alias(f"p{t}") for t in (20, 50, 90)])
    return rounded(out, "p20", "p50", "p90")


@query(f"""
    SELECT player_code, {r6('''CASE WHEN u <= 0.01 THEN vector[1] WHEN u >= 0.99 THEN vector[9]
        ELSE (SELECT max(CASE WHEN u > q[i] AND u <= q[i + 1] THEN vector[i]
              + (vector[i + 1] - vector[i]) * (u - q[i]) / (q[i + 1] - q[i]) END)
              FROM (SELECT unnest(range(1, 9)) AS i)) END''')} AS x
    FROM (SELECT *, ((player_code * 7919) % 1000 + 0.1234567) / 1000.0 AS u,
                 [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99] AS q FROM vectors)""")
def inverse_cdf(r):
    u = ((F.col("player_code") * 7919) % 1000 + F.lit(0.1234567)) / 1000.0
    out = r.vectors().withColumn("u", u).select("player_code",
                                                Q.inverse_cdf("vector", "u").alias("x"))
    return rounded(out, "x")


@query("""
    SELECT player_code, round_even((SELECT sum(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5
           ELSE 0.0 END) FROM (SELECT unnest(a) AS x) CROSS JOIN (SELECT unnest(b) AS y))
           / 81.0, 4) AS p
    FROM (SELECT l.player_code, list_transform(l.vector, lambda v: round(v, 6)) AS a,
                 list_transform(n.vector, lambda v: round(v, 6)) AS b
          FROM vectors l JOIN vectors n ON n.player_code = l.player_code + 1)""")
def prob_greater(r):
    v = r.vectors().select("player_code", F.transform("vector", lambda x: F.round(x, 6))
                           .alias("a"))
    rival = v.select((F.col("player_code") - 1).alias("player_code"), F.col("a").alias("b"))
    return v.join(rival, "player_code").select(
        "player_code", Q.probability_greater("a", "b").alias("p"))


_GRID_TOP = "greatest(vector[9] * 1.05, vector[5] + 1.0, 5.0)"


@query(f"""
    WITH s AS (SELECT player_code, list_transform(vector, lambda x: x / 997.0) AS vector
               FROM vectors),
    g AS (SELECT player_code, vector, i, round_even(i * {_GRID_TOP} / 79, 3) AS t
          FROM s CROSS JOIN (SELECT unnest(range(0, 80)) AS i))
    SELECT player_code, CAST(i AS INTEGER) AS i, {r6("t")} AS x,
           {r6(_below_sql("t"))} AS cdf FROM g""")
def cdf_grid(r):
    """All eighty points of every vector."""
    rows = r.vectors().withColumn("vector", F.transform("vector", lambda x: x / 997.0))
    rows = rows.withColumn("xs", Q.grid("vector", F.element_at("vector", 5)))
    rows = rows.withColumn("cdfs", Q.grid_cdf("vector", "xs"))
    out = rows.select("player_code", F.posexplode(F.arrays_zip("xs", "cdfs")).alias("i", "z"))
    return rounded(out.select("player_code", "i", F.col("z.xs").alias("x"),
                              F.col("z.cdfs").alias("cdf")), "x", "cdf")


_TAILS = ("0", "20000", "35000.5", "60000")


@query("\n    UNION ALL ".join(f"""SELECT player_code, '{t}' AS threshold, round_even({_below_sql(t)}, 4) AS p_le,
           round_even(1.0 - {_below_sql(t)}, 4) AS p_gt FROM vectors""" for t in _TAILS))
def tail_table(r):
    cells = Q.tail_table("vector", ", ".join(_TAILS))
    return r.vectors().select("player_code", F.explode(cells).alias("c")).select(
        "player_code", "c.*")


@query(f"""
    SELECT player_code, {r6("coalesce(list_max(list_filter(z, lambda p: p > 0)), 0.0)")} AS p
    FROM (SELECT player_code, [CASE WHEN vector[1] <= 40000 THEN 0.01 ELSE 0 END,
        CASE WHEN vector[2] <= 40000 THEN 0.05 ELSE 0 END,
        CASE WHEN vector[3] <= 40000 THEN 0.10 ELSE 0 END,
        CASE WHEN vector[4] <= 40000 THEN 0.25 ELSE 0 END,
        CASE WHEN vector[5] <= 40000 THEN 0.50 ELSE 0 END,
        CASE WHEN vector[6] <= 40000 THEN 0.75 ELSE 0 END,
        CASE WHEN vector[7] <= 40000 THEN 0.90 ELSE 0 END,
        CASE WHEN vector[8] <= 40000 THEN 0.95 ELSE 0 END,
        CASE WHEN vector[9] <= 40000 THEN 0.99 ELSE 0 END]::DOUBLE[] AS z FROM vectors)""")
def step_cdf(r):
    out = r.vectors().select("player_code", Q.step_cdf("vector", F.lit(40000.0)).alias("p"))
    return rounded(out, "p")


@query(f"""
    WITH a AS (SELECT player_code, gw, total_points AS actual_points FROM actuals),
    b AS (SELECT a.*, {_below_sql("actual_points * 500.0")} AS below
          FROM a LEFT JOIN vectors USING (player_code))
    SELECT player_code, gw, round_even(below * 100.0, 1) AS percentile,
           round_even(1.0 - below, 4) AS p_exceed, CASE WHEN below >= 0.95 AND actual_points * 500.0 >= 3 THEN 'beat_95th'
           WHEN below <= 0.05 THEN 'below_5th' END AS surprise FROM b""")
def percentile_in_forecast(r):
    rows = r.actuals().select("player_code", "gw", (F.col("total_points") * 500.0).alias("actual_points"))
    years = r.actuals().select("player_code", "gw")
    placed = SK.percentile_of_actual(rows, r.vectors().join(years, "player_code"))
    return placed.select("player_code", "gw", "percentile", "p_exceed", "surprise")


@query(f"""
    WITH v AS (SELECT player_code, position,
                      list_transform(vector, lambda x: x / 997.0) AS vector
               FROM vectors JOIN elements USING (player_code)),
    p AS (SELECT position, {", ".join(f"avg(vector[{i + 1}]) AS p{i}" for i in range(9))}
          FROM v GROUP BY 1),
    e AS (SELECT player_code, position, value AS expected FROM pool)
    SELECT e.player_code, e.position, v.vector IS NOT NULL AS direct,
           {", ".join(r6(f"coalesce(v.vector[{i + 1}], p{i}) + expected - coalesce(v.vector[5], p4)")
                      + f" AS v{i}" for i in range(9))}
    FROM e LEFT JOIN v USING (player_code) LEFT JOIN p ON p.position = e.position""")
def mean_vectors(r):
    known = r.vectors().join(
        r.elements().select("player_code", "position"), "player_code").withColumn(
        "vector", F.transform("vector", lambda x: x / 997.0))
    players = r.pool().select("player_code", "position", F.col("value").alias("expected"))
    return rounded_vector(CO.mean_vectors(known, players), "vector", "player_code", "position",
                          "direct", labels=_LABELS)


# --- residual shapes ---------------------------------------------------------------------

def _residual_rows(r):
    return SK.with_residual(r.scored().withColumn("sigma", F.col("pred_5") * 0.5))


_Z_SQL = "(actual - pred) / greatest(pred_5 * 0.5, 1e-4)"


@query("WITH q AS (SELECT position, quantile_cont(" + _Z_SQL + ", [0.01, 0.05, 0.1, 0.25, 0.5,"
       " 0.75, 0.9, 0.95, 0.99]) AS vector FROM scored GROUP BY 1)\n"
       f"SELECT position, {_VECTOR_COLUMNS} FROM q")
def residual_shape(r):
    shape = SK.exact_residual_quantiles(_residual_rows(r), ["position"])
    return rounded_vector(shape, "z_quantiles", "position", labels=_LABELS)


@query("WITH q AS (SELECT quantile_cont(" + _Z_SQL + ", [0.01, 0.05, 0.1, 0.25, 0.5,"
       " 0.75, 0.9, 0.95, 0.99]) AS z FROM scored),\n"
       "f AS (SELECT player_code, gw, list_transform(z, lambda x: greatest(0.0,"
       " pred + greatest(pred_5 * 0.5, 1e-4) * x)) AS vector FROM scored, q)\n"
       f"SELECT player_code, gw, {_VECTOR_COLUMNS} FROM f")
def quantile_forecast(r):
    rows = _residual_rows(r)
    out = SK.quantile_forecast(rows, SK.exact_residual_quantiles(rows), clip=True)
    return rounded_vector(out, "vector", "player_code", "gw", labels=_LABELS)


@query()
def kll_quantiles(r):
    rows = _residual_rows(r)
    early = SK.residual_sketch(rows.where(F.col("gw") <= 15), ["position"])
    late = SK.residual_sketch(rows.where(F.col("gw") > 15), ["position"])
    return SK.sketch_quantiles(SK.merge_sketches(early, late, ["position"]))
