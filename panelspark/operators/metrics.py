"""Forecast metrics: level, order and calibration, per slice or cohort.

Tables hold ``actual`` and ``pred`` per row, a period ``gw`` and a unique ``player_code``
within the period.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import scale
from panelspark.session import stored


def _error() -> Column:
    return F.col("pred") - F.col("actual")


def _point_aggregates() -> list[Column]:
    return [F.avg(F.abs(_error())).alias("mae"),
            F.sqrt(F.avg(_error() * _error())).alias("rmse"),
            F.count(F.lit(1)).alias("n"), F.avg(_error()).alias("bias")]


def point_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*_point_aggregates())


def pinball_loss(q: float, actual: Column | None = None, pred: Column | None = None) -> Column:
    e = (F.col("actual") if actual is None else actual) - (
        F.col("pred") if pred is None else pred)
    return F.when(e >= 0, F.lit(float(q)) * e).otherwise(F.lit(float(q) - 1.0) * e)


def pinball(df: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(pinball_loss(q)).alias("pinball"))


# --- order -------------------------------------------------------------------

def _average_rank(prefix: str) -> Column:
    return F.col(f"{prefix}_before") + (F.col(f"{prefix}_eq") + 1) / 2.0


def spearman_by_period(df: DataFrame, group: str = "gw") -> DataFrame:
    """Rank correlation per period with average ranks; periods of one row are left out."""
    ranked = scale.rank_cube(df, {c: ([group], [(by, "asc")])
                                  for c, by in (("a", "actual"), ("p", "pred"))})
    return (ranked.groupBy(group)
            .agg(X.correlation(_average_rank("a"), _average_rank("p")).alias("rho"),
                 F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= 2))


def concordance_by_period(df: DataFrame, group: str = "gw") -> DataFrame:
    """Share of ordered row pairs that both columns order alike; ties disagree."""
    return _concordance(df, [group])


def _concordance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = scale.order_code_pairs(df, keys, "actual", "pred")
    return pairs.where(F.col("n") >= 2).select(
        *keys, "n", (2.0 * F.col("concordant") / (F.col("n") * (F.col("n") - 1)))
        .alias("concordance"))


def with_top_fractions(df: DataFrame, flags: Mapping[str, tuple[Sequence[str], str]],
                       top: float = 0.10, tie: str = "player_code") -> DataFrame:
    """Flag the first ``max(1, ceil(n * top))`` rows per group by a column, ties by key.

    ``flags`` maps a flag to its (keys, column); all are placed in one pass.
    """
    placed = scale.rank_cube(df, {f"__{name}": (keys, [(by, "desc"), (tie, "asc")])
                                  for name, (keys, by) in flags.items()})
    for name in flags:
        p = f"__{name}"
        k = F.greatest(F.lit(1), F.ceil(F.col(f"{p}_total") * float(top)))
        placed = placed.withColumn(name, F.col(f"{p}_before") < k).drop(
            f"{p}_eq", f"{p}_before", f"{p}_total")
    return placed


def with_top_fraction(df: DataFrame, keys: Sequence[str], by: str, name: str,
                      top: float = 0.10, tie: str = "player_code") -> DataFrame:
    return with_top_fractions(df, {name: (keys, by)}, top, tie)


def _hits() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("a_top") & F.col("p_top")).alias("hits"),
            F.count_if("a_top").alias("k")]


def topk_hit_rate(df: DataFrame, top: float = 0.10, group: str = "gw") -> DataFrame:
    """Share of the actual top rows that the forecast also put at the top, over all periods."""
    both = with_top_fractions(df, {"a_top": ([group], "actual"), "p_top": ([group], "pred")}, top)
    per = both.groupBy(group).agg(*_hits()).where(F.col("n") >= 2)
    return per.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
                   F.coalesce(F.sum("k"), F.lit(0)).alias("k")).select(
        "hits", "k", F.coalesce(F.try_divide("hits", "k"), F.lit(0.0)).alias("topk_hit_rate"))


def _ranking(df: DataFrame, by: Sequence[str], top: float) -> DataFrame:
    """by, spearman_rho, topk_hit_rate, pairwise_concordance and n for each value of ``by``."""
    keys = [*by, "gw"]
    rows = stored(df.select(*keys, "player_code", "actual", "pred"), "ranking")
    tie = ("player_code", "asc")
    ranked = scale.rank_cube(rows, {
        "a": (keys, [("actual", "asc")]), "p": (keys, [("pred", "asc")]),
        "at": (keys, [("actual", "desc"), tie]), "pt": (keys, [("pred", "desc"), tie])})
    first = lambda p: F.col(f"{p}_before") < F.greatest(
        F.lit(1), F.ceil(F.col(f"{p}_total") * float(top)))
    per = (ranked.withColumns({"a_top": first("at"), "p_top": first("pt")}).groupBy(*keys)
           .agg(X.correlation(_average_rank("a"), _average_rank("p")).alias("rho"), *_hits()))
    counted = F.col("n") >= 2
    whole = per.groupBy(*by).agg(
        F.avg(F.when(counted, F.col("rho"))).alias("spearman_rho"),
        F.coalesce(F.try_divide(F.sum(F.when(counted, F.col("hits"))),
                                F.sum(F.when(counted, F.col("k")))), F.lit(0.0))
        .alias("topk_hit_rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    agree = _concordance(rows, keys).groupBy(*by).agg(
        F.avg("concordance").alias("pairwise_concordance"))
    if by:
        both = whole.join(agree, list(by), "left")
    else:
        both = whole.withColumn("pairwise_concordance", agree.scalar())
    return both.select(*by, "spearman_rho", "topk_hit_rate", "pairwise_concordance", "n")


def ranking_metrics(df: DataFrame, top: float = 0.10) -> DataFrame:
    return _ranking(df, [], top)


def reference_rankings(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Ranking metrics of naive forecasts on the rows with an outcome; missing ones are 0."""
    arms = F.array(*[F.struct(F.lit(n).alias("name"),
                              F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("pred"))
                     for n, c in columns.items()])
    long = df.where(F.col("actual").isNotNull()).select(
        "gw", "player_code", "actual", F.explode(arms).alias("a")).select(
        "gw", "player_code", "actual", "a.*")
    return _ranking(long, ["name"], 0.10)


# --- calibration ----------------------------------------------------------------

def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean forecast and outcome per bin between forecast quantiles; empty bins are absent."""
    edges = scale.exact_quantiles(df, [], "pred", [i / bins for i in range(bins + 1)], "e").scalar()
    lower = F.filter(F.slice("__edges", 1, bins), lambda e: e <= F.col("pred"))
    return (df.select("pred", "actual", edges.alias("__edges"))
            .withColumn("bin", F.size(lower)).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"),
                 F.avg("actual").alias("mean_actual")))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    table = calibration_bins(df, bins)
    gap = F.abs(F.col("mean_pred") - F.col("mean_actual"))
    return table.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")), F.lit(0.0))
                     .alias("ece"))


def _line_aggregates() -> list[Column]:
    return [F.regr_slope("actual", "pred").alias("slope"),
            F.regr_intercept("actual", "pred").alias("intercept")]


def cal_line(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*_line_aggregates())


def calibration_metrics(df: DataFrame, bins: int = 10) -> DataFrame:
    gap = ece(df, bins).scalar()
    ratio = F.try_divide(F.var_pop("actual"), F.var_pop("pred")).alias("variance_ratio")
    one = df.agg(*_point_aggregates(), *_line_aggregates(), ratio)
    return one.select("mae", "rmse", gap.alias("ece"), "slope", "intercept",
                      F.coalesce("variance_ratio", F.lit(float("nan")))
                      .alias("variance_ratio"), "n")


# --- cohorts --------------------------------------------------------------------

def with_cohorts(df: DataFrame, top: float = 0.10, position: str | None = "position") -> DataFrame:
    """Flags ``top10`` and ``top10_by_position``, read from forecasts alone."""
    flags = {"top10": (["gw"], "pred")}
    if position is not None:
        flags["top10_by_position"] = (["gw", position], "pred")
    out = with_top_fractions(df, flags, top)
    return out if position is not None else out.withColumn("top10_by_position", F.lit(False))


def by_cohort(df: DataFrame, cohorts: Mapping[str, Column],
              aggregates: Sequence[Column] | None = None) -> DataFrame:
    """Aggregates per named row subset in one pass; a cohort without rows is absent."""
    names = F.array(*[F.when(flag, F.lit(name)) for name, flag in cohorts.items()])
    return (df.withColumn("cohort", F.explode(F.filter(names, lambda c: c.isNotNull())))
            .groupBy("cohort").agg(*(aggregates or _point_aggregates())))


def cohort_metrics(df: DataFrame, top: float = 0.10) -> DataFrame:
    flagged = with_cohorts(df, top)
    return by_cohort(flagged, {"all": F.lit(True), "top10": F.col("top10"),
                               "top10_by_position": F.col("top10_by_position")})


def top_fractions_by_average_rank(df: DataFrame, flags: Mapping[str, tuple[Sequence[str], str]],
                                  top: float = 0.10) -> DataFrame:
    """Flag rows with average descending rank at most ``n * top`` (no minimum of one).

    ``flags`` maps a flag to its (keys, column); all are ranked in one pass.
    """
    ranked = scale.rank_cube(df, {f"__{name}": (keys, [(by, "desc")])
                                  for name, (keys, by) in flags.items()})
    for name in flags:
        p = f"__{name}"
        ranked = ranked.withColumn(
            name, _average_rank(p) <= F.col(f"{p}_total") * float(top)).drop(
            f"{p}_eq", f"{p}_before", f"{p}_total")
    return ranked


def top_fraction_by_average_rank(df: DataFrame, keys: Sequence[str], by: str, name: str,
                                 top: float = 0.10) -> DataFrame:
    return top_fractions_by_average_rank(df, {name: (keys, by)}, top)


def residual_quantiles(fit: DataFrame, q: float, keys: Sequence[str] = ("position", "bucket")
                       ) -> tuple[DataFrame, DataFrame]:
    """Quantile of actual - pred over all rows (one row) and per group."""
    rows = fit.withColumn("residual", F.col("actual") - F.col("pred"))
    get = lambda part: scale.exact_quantiles(rows, part, "residual", (q,), "v")
    pick = F.get("v", F.lit(0)).alias("residual_q")
    return get([]).select(pick), get(list(keys)).select(*keys, pick)


def tail_comparison(fit: DataFrame, test: DataFrame, q: float,
                    keys: Sequence[str] = ("position", "bucket")) -> DataFrame:
    """Coverage and pinball loss of a shared and a grouped residual quantile, per cohort."""
    whole, grouped = residual_quantiles(fit, q, keys)
    shared = whole.scalar()
    rows = test.join(grouped, list(keys), "left").withColumn(
        "residual_q", F.coalesce("residual_q", shared))
    rows = top_fractions_by_average_rank(rows, {"top10": (["gw"], "pred"),
                                                "top10_by_pos": (["gw", "position"], "pred")})
    arms = F.array(
        F.struct(F.lit("global").alias("arm"), (F.col("pred") + shared).alias("upper")),
        F.struct(F.lit("position+bucket").alias("arm"),
                 (F.col("pred") + F.col("residual_q")).alias("upper")))
    subsets = F.filter(F.array(
        F.lit("all"), F.when(F.col("top10"), F.lit("top10")),
        F.when(F.col("top10_by_pos"), F.lit("top10_by_pos"))), lambda s: s.isNotNull())
    long = (rows.withColumn("a", F.explode(arms)).withColumn("subset", F.explode(subsets))
            .select("subset", "a.arm", "a.upper", "actual"))
    return long.groupBy("subset", "arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("actual") <= F.col("upper")).cast("double")).alias("coverage"),
        F.avg(pinball_loss(q, pred=F.col("upper"))).alias("pinball"))


# --- variance, baselines, shrinkage -------------------------------------------

def variance_scale(validation: DataFrame) -> DataFrame:
    """Factor k that makes forecast variance match squared errors on a window."""
    e = F.col("actual") - F.col("mean")
    return validation.agg(
        F.sqrt(F.avg(e * e) / F.avg(F.col("std") * F.col("std"))).alias("k"))


def spread_metrics(test: DataFrame, scales: Mapping[str, Column]) -> DataFrame:
    """Standardised-error summary of a normal forecast per named spread factor."""
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), k.cast("double").alias("k"))
                     for n, k in scales.items()])
    rows = (test.withColumn("a", F.explode(arms))
            .withColumn("sigma", F.col("a.k") * F.col("std"))
            .withColumn("z", (F.col("actual") - F.col("mean")) / F.col("sigma")))
    z = F.col("z")
    return rows.groupBy(F.col("a.arm").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(z)).alias("mean_abs_z"),
        F.stddev_pop(z).alias("std_z"),
        F.avg((F.abs(z) <= 1).cast("double")).alias("coverage_1"),
        F.avg((F.abs(z) <= 2).cast("double")).alias("coverage_2"),
        F.avg(X.normal_crps(z, F.col("sigma"))).alias("crps"))


def compare_forecasts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Level metrics of several forecast columns on the same rows with an outcome."""
    arms = F.array(*[F.struct(F.lit(n).alias("name"),
                              F.coalesce(F.col(c), F.lit(0.0)).alias("pred"))
                     for n, c in columns.items()])
    long = (df.where(F.col("actual").isNotNull()).withColumn("a", F.explode(arms))
            .select("a.name", "a.pred", "actual"))
    return long.groupBy("name").agg(*_point_aggregates())


def shrinkage_weights(validation: DataFrame, *, steps: int = 10) -> DataFrame:
    """Weight of the grouped forecast per position with the least validation error.

    ``validation`` holds position, actual, pred_global, pred_position. The lowest weight
    wins a tie.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps))
    blend = F.col("pred_global") + F.col("alpha") * (
        F.col("pred_position") - F.col("pred_global"))
    errors = (validation.withColumn("alpha", F.explode(grid))
              .groupBy("position", "alpha")
              .agg(F.avg(F.abs(F.col("actual") - blend)).alias("mae")))
    best = errors.groupBy("position").agg(
        F.min(F.struct(F.round("mae", 12).alias("mae"), "alpha")).alias("s"))
    return best.select("position", "s.alpha", F.col("s.mae").alias("mae"))


def apply_shrinkage(test: DataFrame, weights: DataFrame) -> DataFrame:
    joined = test.join(weights.select("position", "alpha"), "position", "left")
    alpha = F.coalesce("alpha", F.lit(0.0))
    return joined.withColumn("pred_blend", F.col("pred_global") + alpha * (
        F.col("pred_position") - F.col("pred_global"))).drop("alpha")


def role_cohorts(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Level metrics for all rows, regular and other entities, by trailing role rates."""
    joined = df.join(rates, ["player_id", "gw"], "left")
    # Shares of minutes and starts that make an entity regular.
    regular = F.coalesce((F.col("minutes_share_5") >= 0.5) & (F.col("start_rate_5") >= 0.4),
                         F.lit(False))
    return by_cohort(joined, {"all": F.lit(True), "regular": regular, "nonregular": ~regular})
