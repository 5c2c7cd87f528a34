"""Forecast metric queries over the scored panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import metrics as M
from panelspark.operators import models as ML
from panelspark.operators import panel as P
from panelspark.plans.pair_queries import phi_sql
from panelspark.plans.registry import query, rounded
from panelspark.plans.roles_sql import corr_sql, r6
from panelspark.session import stored

_POINT = f"""{r6("avg(abs(pred - actual))")} AS mae,
             {r6("sqrt(avg((pred - actual) * (pred - actual)))")} AS rmse, count(*) AS n,
             {r6("avg(pred - actual)")} AS bias"""


def _point(df):
    return rounded(df, "mae", "rmse", "bias")


@query(f"SELECT position, {_POINT} FROM scored GROUP BY 1")
def point_metrics(r):
    return _point(M.point_metrics(r.scored(), ["position"]))


@query(f"""SELECT gw, {r6('''avg(CASE WHEN actual >= pred THEN 0.9 * (actual - pred)
           ELSE (0.9 - 1.0) * (actual - pred) END)''')} AS pinball FROM scored GROUP BY 1""")
def pinball(r):
    return rounded(M.pinball(r.scored(), 0.9, ["gw"]), "pinball")


_RANKED = """
    SELECT gw, rank() OVER (PARTITION BY gw ORDER BY actual)
               + (count(*) OVER (PARTITION BY gw, actual) - 1) / 2.0 AS ra,
           rank() OVER (PARTITION BY gw ORDER BY pred)
               + (count(*) OVER (PARTITION BY gw, pred) - 1) / 2.0 AS rp FROM scored"""


@query(f"""WITH k AS ({_RANKED}) SELECT gw, {corr_sql("ra", "rp")} AS rho, count(*) AS n
           FROM k GROUP BY 1 HAVING count(*) >= 2""")
def spearman(r):
    return rounded(M.spearman_by_period(r.scored()), "rho")


_TOP = """
    SELECT s.gw, a <= greatest(1, ceil(n * 0.1)) AS a_top, p <= greatest(1, ceil(n * 0.1)) AS p_top
    FROM (SELECT gw, row_number() OVER (PARTITION BY gw ORDER BY actual DESC, player_code) AS a,
                 row_number() OVER (PARTITION BY gw ORDER BY pred DESC, player_code) AS p,
                 count(*) OVER (PARTITION BY gw) AS n FROM scored) s WHERE n >= 2"""


@query(f"""WITH t AS ({_TOP}) SELECT count(*) FILTER (a_top AND p_top) AS hits,
           count(*) FILTER (a_top) AS k,
           {r6("count(*) FILTER (a_top AND p_top) / count(*) FILTER (a_top)")} AS topk_hit_rate FROM t""")
def topk_hit(r):
    return rounded(M.topk_hit_rate(r.scored()), "topk_hit_rate")


@query(f"""
    SELECT a.gw, n, {r6('''count(*) FILTER ((a.actual - b.actual) * (a.pred - b.pred) > 0)
           / (n * (n - 1))''')} AS concordance
    FROM scored a JOIN scored b ON a.gw = b.gw AND a.player_code <> b.player_code
    JOIN (SELECT gw, count(*) AS n FROM scored GROUP BY 1) c ON c.gw = a.gw GROUP BY 1, 2""")
def concordance(r):
    return rounded(M.concordance_by_period(r.scored()), "concordance")


@query(f"""
    WITH k AS ({_RANKED}), rho AS (SELECT gw, corr(ra, rp) AS v FROM k GROUP BY 1
                                   HAVING count(*) >= 2),
    t AS ({_TOP}),
    con AS (SELECT a.gw, count(*) FILTER ((a.actual - b.actual) * (a.pred - b.pred) > 0)
                   / count(*) AS v
            FROM scored a JOIN scored b ON a.gw = b.gw AND a.player_code <> b.player_code
            GROUP BY 1)
    SELECT {r6("(SELECT avg(v) FROM rho)")} AS spearman_rho,
           {r6("(SELECT count(*) FILTER (a_top AND p_top) / count(*) FILTER (a_top) FROM t)")}
           AS topk_hit_rate,
           {r6("(SELECT avg(v) FROM con)")} AS pairwise_concordance,
           (SELECT count(*) FROM scored) AS n""")
def ranking_metrics(r):
    return rounded(M.ranking_metrics(r.scored()), "spearman_rho", "topk_hit_rate",
                   "pairwise_concordance")


def _reference_sql(name: str, pred: str) -> str:
    """Ranking metrics of one naive forecast."""
    return f"""
    SELECT '{name}' AS name,
           (SELECT round(avg(v), 6) FROM (SELECT corr(ra, rp) AS v FROM (
               SELECT gw, rank() OVER (PARTITION BY gw ORDER BY actual)
                   + (count(*) OVER (PARTITION BY gw, actual) - 1) / 2.0 AS ra,
                   rank() OVER (PARTITION BY gw ORDER BY {pred})
                   + (count(*) OVER (PARTITION BY gw, {pred}) - 1) / 2.0 AS rp FROM scored)
               GROUP BY gw HAVING count(*) >= 2)) AS spearman_rho,
           (SELECT round(count(*) FILTER (a <= k AND p <= k) / count(*) FILTER (a <= k), 6)
            FROM (SELECT row_number() OVER (PARTITION BY gw ORDER BY actual DESC, player_code)
                      AS a,
                  row_number() OVER (PARTITION BY gw ORDER BY {pred} DESC, player_code) AS p,
                  greatest(1, ceil(count(*) OVER (PARTITION BY gw) * 0.1)) AS k FROM scored))
           AS topk_hit_rate,
           (SELECT round(avg(v), 6) FROM (
               SELECT count(*) FILTER ((a.actual - b.actual) * (a.{pred} - b.{pred}) > 0)
                      / count(*) AS v
               FROM scored a JOIN scored b ON a.gw = b.gw AND a.player_code <> b.player_code
               GROUP BY a.gw)) AS pairwise_concordance,
           (SELECT count(*) FROM scored) AS n"""


@query(_reference_sql("persist", "prev_points") + " UNION ALL "
       + _reference_sql("external", "now_cost"))
def reference_rankings(r):
    out = M.reference_rankings(r.scored(), {"persist": "prev_points", "external": "now_cost"})
    return rounded(out, "spearman_rho", "topk_hit_rate", "pairwise_concordance")


_BINS = """
    SELECT s.*, len(list_filter(e[1:10], lambda x: x <= pred)) AS bin FROM scored s,
    (SELECT quantile_cont(pred, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e
     FROM scored)"""


@query(f"""
    WITH b AS ({_BINS}), g AS (SELECT bin, count(*) AS n, abs(avg(pred) - avg(actual)) AS d
                               FROM b GROUP BY 1)
    SELECT {r6("sum(n * d) / sum(n)")} AS ece FROM g""")
def ece(r):
    return rounded(M.ece(r.scored()), "ece")


@query(f"""SELECT gw, {r6("regr_slope(actual, pred)")} AS slope,
           {r6("regr_intercept(actual, pred)")} AS intercept FROM scored GROUP BY 1
           HAVING count(*) > 2""")
def cal_line(r):
    keep = r.scored().groupBy("gw").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2)
    return rounded(M.cal_line(r.scored(), ["gw"]).join(keep.select("gw"), "gw"),
                   "slope", "intercept")


@query(f"""
    WITH b AS ({_BINS}), g AS (SELECT bin, count(*) AS n, abs(avg(pred) - avg(actual)) AS d
                               FROM b GROUP BY 1)
    SELECT {r6("avg(abs(pred - actual))")} AS mae,
           {r6("sqrt(avg((pred - actual) * (pred - actual)))")} AS rmse,
           {r6("(SELECT sum(n * d) / sum(n) FROM g)")} AS ece,
           {r6("regr_slope(actual, pred)")} AS slope,
           {r6("regr_intercept(actual, pred)")} AS intercept,
           {r6("var_pop(actual) / var_pop(pred)")} AS variance_ratio, count(*) AS n
    FROM scored""")
def calibration(r):
    return rounded(M.calibration_metrics(r.scored()), "mae", "rmse", "ece", "slope",
                   "intercept", "variance_ratio")


@query(f"""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY gw ORDER BY pred DESC, player_code)
                   <= greatest(1, ceil(count(*) OVER (PARTITION BY gw) * 0.1)) AS t,
               row_number() OVER (PARTITION BY gw, position ORDER BY pred DESC, player_code)
                   <= greatest(1, ceil(count(*) OVER (PARTITION BY gw, position) * 0.1)) AS tp
               FROM scored)
    SELECT 'all' AS cohort, {_POINT} FROM c
    UNION ALL SELECT 'top10', {_POINT} FROM c WHERE t
    UNION ALL SELECT 'top10_by_position', {_POINT} FROM c WHERE tp""")
def cohorts(r):
    return _point(M.cohort_metrics(r.scored()))


_BUCKET = ("CASE WHEN pred < 20 THEN 'low' WHEN pred < 40 THEN 'mid' "
           "WHEN pred < 60 THEN 'high' ELSE 'elite' END")


def _bucketed(r):
    return r.scored().withColumn("bucket", X.level_bucket(F.col("pred") / 10.0))


@query(f"""
    SELECT position, {_BUCKET} AS bucket, {r6("quantile_cont(actual - pred, 0.9)")}
           AS residual_q FROM scored GROUP BY 1, 2""")
def residual_quantiles(r):
    return rounded(M.residual_quantiles(_bucketed(r), 0.9)[1], "residual_q")


@query(f"""
    WITH s AS (SELECT *, {_BUCKET} AS bucket FROM scored),
    fit AS (SELECT * FROM s WHERE gw <= 15),
    g AS (SELECT quantile_cont(actual - pred, 0.9) AS g FROM fit),
    q AS (SELECT position, bucket, quantile_cont(actual - pred, 0.9) AS q FROM fit GROUP BY 1, 2),
    t AS (SELECT s.*, g, coalesce(q, g) AS rq,
                 rank() OVER (PARTITION BY gw ORDER BY pred DESC)
                 + (count(*) OVER (PARTITION BY gw, pred) - 1) / 2.0
                 <= count(*) OVER (PARTITION BY gw) * 0.1 AS t,
                 rank() OVER (PARTITION BY gw, position ORDER BY pred DESC)
                 + (count(*) OVER (PARTITION BY gw, position, pred) - 1) / 2.0
                 <= count(*) OVER (PARTITION BY gw, position) * 0.1 AS tp
          FROM s CROSS JOIN g LEFT JOIN q USING (position, bucket) WHERE gw > 15),
    sub AS (SELECT 'all' AS subset, * FROM t UNION ALL SELECT 'top10', * FROM t WHERE t
            UNION ALL SELECT 'top10_by_pos', * FROM t WHERE tp),
    arm AS (SELECT subset, 'global' AS arm, actual, pred + g AS upper FROM sub
            UNION ALL SELECT subset, 'position+bucket', actual, pred + rq FROM sub)
    SELECT subset, arm, count(*) AS n,
           {r6("avg(CASE WHEN actual <= upper THEN 1.0 ELSE 0.0 END)")} AS coverage,
           {r6('''avg(CASE WHEN actual >= upper THEN 0.9 * (actual - upper)
               ELSE (0.9 - 1.0) * (actual - upper) END)''')} AS pinball
    FROM arm GROUP BY 1, 2""")
def tail_comparison(r):
    rows = _bucketed(r)
    out = M.tail_comparison(rows.where(F.col("gw") <= 15), rows.where(F.col("gw") > 15), 0.9)
    return rounded(out, "coverage", "pinball")


def _spread_rows(r):
    return r.scored().select("gw", "actual", F.col("pred").alias("mean"),
                             (F.col("pred_5") * 0.3 + 1.0).alias("std"))


_SPREAD = "SELECT gw, actual, pred AS mean, pred_5 * 0.3 + 1.0 AS std FROM scored"


@query(f"""WITH v AS ({_SPREAD}) SELECT {r6('''sqrt(avg((actual - mean) * (actual - mean))
           / avg(std * std))''')} AS k FROM v WHERE gw <= 15""")
def variance_scale(r):
    return rounded(M.variance_scale(_spread_rows(r).where(F.col("gw") <= 15)), "k")


@query(f"""
    WITH v AS ({_SPREAD}),
    k AS (SELECT sqrt(avg((actual - mean) * (actual - mean)) / avg(std * std)) AS k FROM v
          WHERE gw <= 15),
    z AS (SELECT 'raw' AS arm, std AS sigma, (actual - mean) / std AS z FROM v WHERE gw > 15
          UNION ALL SELECT 'calibrated', k * std, (actual - mean) / (k * std) FROM v, k
          WHERE gw > 15)
    SELECT arm, count(*) AS n, {r6("avg(abs(z))")} AS mean_abs_z,
           {r6("stddev_pop(z)")} AS std_z,
           {r6("avg(CASE WHEN abs(z) <= 1 THEN 1.0 ELSE 0.0 END)")} AS coverage_1,
           {r6("avg(CASE WHEN abs(z) <= 2 THEN 1.0 ELSE 0.0 END)")} AS coverage_2,
           {r6(f'''avg(sigma * (z * (2 * {phi_sql("z")} - 1)
               + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))''')} AS crps
    FROM z GROUP BY 1""")
def spread_metrics(r):
    rows = _spread_rows(r)
    k = M.variance_scale(rows.where(F.col("gw") <= 15)).scalar()
    out = M.spread_metrics(rows.where(F.col("gw") > 15), {"raw": F.lit(1.0), "calibrated": k})
    return rounded(out, "mean_abs_z", "std_z", "coverage_1", "coverage_2", "crps")


@query(f"""
    WITH x AS (SELECT *, (SELECT avg(actual) FROM scored WHERE gw <= 15) AS m FROM scored
               WHERE gw > 15),
    l AS (SELECT 'model' AS name, actual, pred FROM x
          UNION ALL SELECT 'persist', actual, coalesce(prev_points, 0.0) FROM x
          UNION ALL SELECT 'external', actual, coalesce(now_cost, 0.0) FROM x
          UNION ALL SELECT 'constant', actual, m FROM x)
    SELECT name, {_POINT} FROM l GROUP BY 1""")
def baselines(r):
    rows = r.scored()
    mean = rows.where(F.col("gw") <= 15).agg(F.avg("actual")).scalar()
    test = rows.where(F.col("gw") > 15).withColumn("mean", mean)
    return _point(M.compare_forecasts(test, {
        "model": "pred", "persist": "prev_points", "external": "now_cost",
        "constant": "mean"}))


@query(f"""
    WITH v AS (SELECT position, actual, pred AS g, pred_5 AS p FROM scored WHERE gw <= 15),
    e AS (SELECT position, i / 10.0 AS alpha,
                 round(avg(abs(actual - (g + i / 10.0 * (p - g)))), 9) AS mae
          FROM v, (SELECT unnest(range(0, 11)) AS i) GROUP BY 1, 2),
    best AS (SELECT position, alpha FROM (SELECT *, row_number() OVER (
                 PARTITION BY position ORDER BY mae, alpha) AS rn FROM e) WHERE rn = 1)
    SELECT position, {r6("alpha")} AS alpha,
           {r6("avg(abs(actual - (pred + alpha * (pred_5 - pred))))")} AS mae_blend
    FROM scored JOIN best USING (position) WHERE gw > 15 GROUP BY 1, 2""")
def shrinkage(r):
    rows = r.scored().withColumnsRenamed({"pred": "pred_global", "pred_5": "pred_position"})
    weights = M.shrinkage_weights(rows.where(F.col("gw") <= 15))
    blended = M.apply_shrinkage(rows.where(F.col("gw") > 15), weights)
    out = blended.join(weights.select("position", "alpha"), "position").groupBy(
        "position", "alpha").agg(
        F.avg(F.abs(F.col("actual") - F.col("pred_blend"))).alias("mae_blend"))
    return rounded(out, "alpha", "mae_blend")


@query(f"""
    WITH rr AS (SELECT player_id, gw,
        sum(CASE WHEN starts > 0 THEN 1 ELSE 0 END) OVER w / 5.0 AS sr,
        sum(least(CAST(minutes AS DOUBLE), 90.0)) OVER w / 450.0 AS ms FROM panel
        WINDOW w AS (PARTITION BY player_id ORDER BY gw ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    j AS (SELECT s.*, coalesce(ms >= 0.5 AND sr >= 0.4, FALSE) AS reg
          FROM scored s LEFT JOIN rr USING (player_id, gw))
    SELECT 'all' AS cohort, {_POINT} FROM j
    UNION ALL SELECT 'regular', {_POINT} FROM j WHERE reg HAVING count(*) > 0
    UNION ALL SELECT 'nonregular', {_POINT} FROM j WHERE NOT reg HAVING count(*) > 0""")
def role_cohorts(r):
    return _point(M.role_cohorts(r.scored(), P.role_rates(r.panel())))


def _ml_rows(r):
    stats = r.panel().withColumn("ep_next", F.col("starts") * F.lit(1.5))
    return P.model_rows(r.features(), r.players(), stats)


@query()
def gbt_forecast(r):
    """Trees on the first half of the month, level metrics on the second, in cohorts."""
    rows = _ml_rows(r)
    model = ML.fit(rows.where(F.col("gw") <= 15))
    scored = ML.predict(model, rows.where(F.col("gw") > 15)).withColumn(
        "actual", F.col("next_points").cast("double"))
    return M.cohort_metrics(scored.select("player_code", "gw", "position", "actual", "pred"))


@query()
def ridge_forecast(r):
    rows = _ml_rows(r)
    model = ML.fit(rows.where(F.col("gw") <= 15), "ridge", reg=1.0)
    scored = ML.predict(model, rows.where(F.col("gw") > 15), kind="ridge").withColumn(
        "actual", F.col("next_points").cast("double"))
    return M.point_metrics(scored, ["position"])


@query()
def sigma_and_positions(r):
    """Spread regressor and per-position trees on the middle of the month, blended."""
    # Six fits read the rows again and again; what they derive from is worked out once.
    rows = stored(_ml_rows(r), "model-rows")
    fit, held, test = (rows.where(F.col("gw") <= 10), rows.where(F.col("gw").between(11, 18)),
                       rows.where(F.col("gw") > 18))
    point = ML.fit(fit)
    sigma = ML.fit_sigma(ML.predict(point, held))
    parts = ML.fit_by_position(fit)
    blend = ML.predict_by_position(parts, ML.predict(point, test, name="pred_global"),
                                   other="pred_global")
    out = ML.predict(sigma, blend, name="sigma")
    return out.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sigma").alias("mean_sigma"),
        F.avg(F.abs(F.col("next_points") - F.col("pred_global"))).alias("mae_global"),
        F.avg(F.abs(F.col("next_points") - F.col("pred_position"))).alias("mae_position"))
