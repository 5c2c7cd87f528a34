"""Co-movement of entities: shared-period means, pair covariances, correlations.

Sums over pairs are written with group sums: over the unordered pairs of a group,
sum(x_i * x_j) = ((sum x)^2 - sum x^2) / 2. No pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import scale


def with_without(focal: DataFrame, other: DataFrame, on: Sequence[str],
                 value: str = "total_points") -> DataFrame:
    """Mean and count of the focal rows with, without and regardless of the other entity."""
    mark = other.select(*on).distinct().withColumn("__with", F.lit(True))
    flagged = focal.join(mark, list(on), "left")
    split = F.when(F.col("__with"), "with").otherwise("without")
    return (flagged.withColumn("grp", F.explode(F.array(split, F.lit("overall"))))
            .groupBy("grp").agg(F.count(value).alias("n"), F.avg(value).alias("mean")))


def _pair_sum(total: Column, squares: Column) -> Column:
    return (total * total - squares) / 2.0


def _pair_count(n: Column) -> Column:
    return n * (n - 1) / 2.0


def same_group_products(residuals: DataFrame, group: Sequence[str] = ("gw", "team_code"),
                        value: str = "resid") -> DataFrame:
    """Count and mean product over unordered pairs within a group (one row)."""
    v = F.col(value)
    sums = residuals.groupBy(*group).agg(
        F.count(value).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    return sums.agg(
        F.sum(_pair_count(F.col("n"))).cast("bigint").alias("pairs"),
        F.sum(_pair_sum(F.col("s"), F.col("q"))).alias("products")).select(
        "pairs", F.try_divide("products", "pairs").alias("mean_product"))


def opponent_products(residuals: DataFrame, value: str = "resid") -> DataFrame:
    """Same over pairs of entities whose clubs met each other in the period."""
    v = F.col(value)
    clubs = residuals.where(F.col("opponent_team_code").isNotNull()).groupBy(
        "gw", "team_code", "opponent_team_code").agg(
        F.count(value).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    rival = clubs.select("gw", F.col("team_code").alias("opponent_team_code"),
                         F.col("opponent_team_code").alias("team_code"),
                         F.col("n").alias("rn"), F.col("s").alias("rs"))
    own = F.col("team_code") == F.col("opponent_team_code")
    met = (clubs.join(rival, ["gw", "team_code", "opponent_team_code"])
           .where(F.col("team_code") <= F.col("opponent_team_code")))
    return met.agg(
        F.sum(F.when(own, _pair_count(F.col("n"))).otherwise(F.col("n") * F.col("rn")))
        .cast("bigint").alias("pairs"),
        F.sum(F.when(own, _pair_sum(F.col("s"), F.col("q")))
              .otherwise(F.col("s") * F.col("rs"))).alias("products")).select(
        "pairs", F.try_divide("products", "pairs").alias("mean_product"))


def residual_structure(residuals: DataFrame, value: str = "resid") -> DataFrame:
    """Pooled variance, same-club and opponent covariance, clipped same-club correlation."""
    alpha = same_group_products(residuals, value=value)
    beta = opponent_products(residuals, value=value)
    one = residuals.agg(F.var_samp(value).alias("pooled"))
    a, b = alpha.select("mean_product").scalar(), beta.select("mean_product").scalar()
    rho = F.least(F.greatest(a / F.col("pooled"), F.lit(0.0)), F.lit(0.25))
    return one.select("pooled", a.alias("alpha"), b.alias("beta"), rho.alias("rho"))


def entity_variance(residuals: DataFrame, value: str = "resid") -> DataFrame:
    """Residual variance per entity; the pooled variance where one row gives none."""
    pooled = residuals.agg(F.var_samp(value)).scalar()
    return residuals.groupBy("player_code").agg(
        F.coalesce(F.var_samp(value), pooled).alias("sig2"))


def squad_variance(members: DataFrame, variance: DataFrame, matches: DataFrame,
                   structure: DataFrame) -> DataFrame:
    """Spread of a squad's total with same-club and opponent pairs, and its two z-scores.

    ``members`` holds (squad, gw, player_code, team_code, expected, actual).
    """
    pooled, alpha, beta = (structure.select(c).scalar() for c in ("pooled", "alpha", "beta"))
    rows = members.join(variance, "player_code", "left").withColumn(
        "sig2", F.coalesce("sig2", pooled))
    clubs = rows.groupBy("squad", "gw", "team_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("expected").alias("expected"),
        F.sum("actual").alias("actual"), F.sum("sig2").alias("var_iid"))
    met = matches.select("gw", F.least("home_team", "away_team").alias("a"),
                         F.greatest("home_team", "away_team").alias("b")).distinct()
    carried = ("expected", "actual", "var_iid")
    teams = clubs.groupBy("squad", "gw").agg(
        *[F.sum(c).alias(c) for c in carried],
        F.sum(_pair_count(F.col("n"))).cast("bigint").alias("same"),
        F.collect_list(F.when(F.col("team_code").isNotNull(),       # one entry for each club
                              F.struct(F.col("team_code").alias("c"), "n"))).alias("clubs"))
    # The clubs of a squad against each other, then looked up among the matches of the period:
    # no rows for opponents that the squad does not hold, and none is dealt again.
    each = teams.where(F.col("squad").isNotNull() & F.col("gw").isNotNull()).select(
        "squad", "gw", *carried, "same", "clubs", F.explode_outer("clubs").alias("x")).select(
        "squad", "gw", *carried, "same", "x",
        F.explode_outer(F.filter("clubs", lambda y: y["c"] >= F.col("x.c"))).alias("y")).select(
        "squad", "gw", *carried, "same", F.col("x.c").alias("a"), F.col("x.n").alias("na"),
        F.col("y.c").alias("b"), F.col("y.n").alias("nb"))
    known = F.broadcast(met.withColumn("met", F.lit(True)))     # bounded by periods and clubs
    pairs = F.when(F.col("met"), F.when(
        F.col("a") == F.col("b"), _pair_count(F.col("na"))).otherwise(F.col("na") * F.col("nb")))
    opp = each.join(known, ["gw", "a", "b"], "left").groupBy("squad", "gw").agg(
        *[F.first(c).alias(c) for c in (*carried, "same")],
        F.sum(pairs).cast("bigint").alias("opp"))
    error = F.col("actual") - F.col("expected")
    return (
        opp.withColumn("opp", F.coalesce("opp", F.lit(0).cast("bigint")))
        .withColumn("var_cov", F.col("var_iid") + 2 * alpha * F.col("same")
                    - 2 * beta * F.col("opp"))
        .where((F.col("var_iid") > 1e-9) & (F.col("var_cov") > 1e-9))
        .withColumns({"z_iid": error / F.sqrt("var_iid"), "z_cov": error / F.sqrt("var_cov")}))


# --- correlations -------------------------------------------------------------

def driver_correlations(df: DataFrame, drivers: Sequence[str], target: str,
                        group: str | None = None) -> DataFrame:
    """Pearson correlation of every driver with the target, one scan, one row per driver."""
    keys = [group] if group else []
    wide = df.groupBy(*keys).agg(*[X.correlation(d, target).alias(d)
                                   for d in drivers])
    return wide.unpivot(keys, list(drivers), "feature", "r")


def driver_correlations_wide(df: DataFrame, drivers: Sequence[str], target: str,
                             group: str) -> DataFrame:
    return df.groupBy(group).agg(*[X.correlation(d, target).alias(d)
                                   for d in drivers])


def collinearity(df: DataFrame, drivers: Sequence[str]) -> DataFrame:
    """Correlation of every ordered pair of drivers, one scan."""
    wide = df.agg(*[X.correlation(a, b)
                    .alias(f"c_{i}_{j}")
                    for i, a in enumerate(drivers) for j, b in enumerate(drivers) if i < j])

    def cell(i: int, j: int) -> Column:
        r = F.lit(1.0) if i == j else F.col(f"c_{min(i, j)}_{max(i, j)}")
        return F.struct(F.lit(drivers[i]).alias("a"), F.lit(drivers[j]).alias("b"),
                        r.alias("r"))

    cells = F.array(*[cell(i, j) for i in range(len(drivers)) for j in range(len(drivers))])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def entity_pair_correlation(grid: DataFrame, qualified: DataFrame,
                            min_group: int = 3) -> DataFrame:
    """Mean correlation of entity pairs in the same group and across groups (one row).

    ``grid`` holds (player_code, gw, total_points), ``qualified`` (player_code, team_code).
    A missing period counts as 0. With every series centred and scaled to length 1, the
    correlations of a group's pairs sum to (|sum of series|^2 - members) / 2, and the sum
    series needs one value per (group, period). Entities without spread have no series.
    """
    rows = grid.join(qualified, "player_code")
    t = rows.agg(F.countDistinct("gw")).scalar()
    x = F.col("total_points").cast("double")
    series = (
        rows.groupBy("player_code", "team_code").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
        .withColumn("mean", F.col("s") / t)
        .withColumn("ss", F.col("q") - t * F.col("mean") * F.col("mean")))
    size = series.groupBy("team_code").agg(F.count(F.lit(1)).alias("members"))
    unit = (series.where(F.col("ss") > 1e-9)
            .select("player_code", "mean", F.sqrt("ss").alias("norm")))
    scaled = rows.join(unit, "player_code")
    shift = (scaled.select("player_code", "team_code", "mean", "norm").distinct()
             .groupBy("team_code")
             .agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("mean") / F.col("norm")).alias("c")))
    sums = scaled.groupBy("team_code", "gw").agg(F.sum(x / F.col("norm")).alias("a"))
    within = (
        sums.join(shift, "team_code").groupBy("team_code", "m", "c")
        .agg(F.sum(F.col("a") * F.col("a") - 2 * F.col("a") * F.col("c")).alias("d"))
        .withColumn("r", (F.col("d") + t * F.col("c") * F.col("c") - F.col("m")) / 2.0)
        .join(size, "team_code")
        .withColumn("pairs", _pair_count(F.col("m"))))
    large = F.col("members") >= min_group
    inside = within.agg(
        F.sum(F.when(large, F.col("pairs"))).alias("same_pairs"),
        F.sum(F.when(large, F.col("r"))).alias("same_r"),
        F.sum("pairs").alias("in_pairs"), F.sum("r").alias("in_r"), F.sum("m").alias("m"),
        F.sum("c").alias("c"))
    whole = sums.groupBy("gw").agg(F.sum("a").alias("a")).agg(
        F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum("a").alias("a1"))
    aa, a1 = whole.select("aa").scalar(), whole.select("a1").scalar()
    all_r = (aa - 2 * a1 * F.col("c") + t * F.col("c") * F.col("c") - F.col("m")) / 2.0
    cross_pairs = _pair_count(F.col("m")) - F.col("in_pairs")
    return inside.select(
        F.col("same_pairs").cast("bigint").alias("same_pairs"),
        F.try_divide("same_r", "same_pairs").alias("same_mean_r"),
        cross_pairs.cast("bigint").alias("cross_pairs"),
        F.try_divide(all_r - F.col("in_r"), cross_pairs).alias("cross_mean_r"))


# --- tables of means ----------------------------------------------------------

def position_baselines(panel: DataFrame, players: DataFrame) -> DataFrame:
    return (panel.where(F.col("minutes") > 0)
            .join(players.select("player_id", "position"), "player_id")
            .groupBy("position")
            .agg(F.avg("total_points").alias("mean"),
                 F.count("total_points").alias("played_gw")))


def quartile_table(df: DataFrame, bucket_by: str, target: str,
                   group: str = "position") -> DataFrame:
    """Mean target per group and quartile of another column."""
    cuts = scale.exact_quantiles(df, [], bucket_by, (0.25, 0.5, 0.75), "cuts").scalar()
    b = F.col(bucket_by)
    quarter = (F.when(b < F.get(cuts, F.lit(0)), 1).when(b < F.get(cuts, F.lit(1)), 2)
               .when(b < F.get(cuts, F.lit(2)), 3).otherwise(4))
    return (df.withColumn("opp_q", quarter).groupBy(group, "opp_q")
            .agg(F.avg(target).alias("mean_pts"), F.count(target).alias("n")))


def venue_table(df: DataFrame, target: str, group: str = "position") -> DataFrame:
    return df.groupBy(group, "was_home").agg(F.avg(target).alias("mean_pts"))


def team_totals(panel: DataFrame, players: DataFrame) -> DataFrame:
    rows = panel.where(F.col("minutes") > 0).join(
        players.select("player_id", "team_code", "position"), "player_id")
    return rows.groupBy("team_code", "gw").agg(F.sum("total_points").alias("own_total"))


def with_team_totals(panel: DataFrame, players: DataFrame, matches: DataFrame) -> DataFrame:
    """Every played row with its own club's and its opponent's total of the period."""
    rows = panel.where(F.col("minutes") > 0).join(
        players.select("player_id", "team_code", "position"), "player_id")
    own = rows.groupBy("team_code", "gw").agg(F.sum("total_points").alias("own_total"))
    sides = matches.select("gw", F.explode(F.array(
        F.struct(F.col("home_team").alias("t"), F.col("away_team").alias("o")),
        F.struct(F.col("away_team").alias("t"), F.col("home_team").alias("o")))).alias("s"))
    opp = (sides.select("gw", F.col("s.t").alias("team_code"), F.col("s.o").alias("opp"))
           .join(own.select("gw", F.col("team_code").alias("opp"),
                            F.col("own_total").alias("opp_total")), ["gw", "opp"])
           .select("gw", "team_code", "opp_total"))
    return rows.join(own, ["team_code", "gw"]).join(opp, ["team_code", "gw"])


def _weighted_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column,
                   sxy: Column) -> Column:
    return F.try_divide(n * sxy - sx * sy,
                        F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))


def shared_fixture_correlations(panel: DataFrame, players: DataFrame,
                                matches: DataFrame) -> DataFrame:
    """Correlation with the own and the opposing total: overall and per position.

    Counted over every (row, fixture of its club), but rows and fixtures of one club and
    period meet as sums, so a period with many fixtures copies nothing.
    """
    rows = panel.where(F.col("minutes") > 0).join(
        players.select("player_id", "team_code", "position"), "player_id")
    x = F.col("total_points")
    cells = rows.groupBy("team_code", "gw", "position").agg(
        F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    own = cells.groupBy("team_code", "gw").agg(F.sum("sx").alias("o"))
    sides = matches.select("gw", F.explode(F.array(
        F.struct(F.col("home_team").alias("t"), F.col("away_team").alias("o")),
        F.struct(F.col("away_team").alias("t"), F.col("home_team").alias("o")))).alias("s"))
    met = sides.groupBy("gw", F.col("s.t").alias("team_code"), F.col("s.o").alias("opp")).agg(
        F.count(F.lit(1)).alias("k"))
    faced = (met.join(own.select("gw", F.col("team_code").alias("opp"),
                                 F.col("o").alias("p")), ["gw", "opp"])
             .groupBy("team_code", "gw")
             .agg(F.sum("k").alias("f"), F.sum(F.col("k") * F.col("p")).alias("sp"),
                  F.sum(F.col("k") * F.col("p") * F.col("p")).alias("spp")))
    c = F.col
    sums = (cells.join(own, ["team_code", "gw"]).join(faced, ["team_code", "gw"])
            .withColumn("scope", F.explode(F.array(F.lit("overall"), c("position"))))
            .groupBy("scope").agg(
                F.sum(c("f") * c("n")).alias("N"),
                F.sum(c("f") * c("sx")).alias("X"), F.sum(c("f") * c("sxx")).alias("XX"),
                F.sum(c("f") * c("n") * c("o")).alias("O"),
                F.sum(c("f") * c("n") * c("o") * c("o")).alias("OO"),
                F.sum(c("f") * c("sx") * c("o")).alias("XO"),
                F.sum(c("n") * c("sp")).alias("P"), F.sum(c("n") * c("spp")).alias("PP"),
                F.sum(c("sx") * c("sp")).alias("XP")))
    return sums.select(
        "scope",
        _weighted_corr(c("N"), c("X"), c("O"), c("XX"), c("OO"), c("XO")).alias("vs_own_team"),
        _weighted_corr(c("N"), c("X"), c("P"), c("XX"), c("PP"), c("XP")).alias("vs_opponent"))


def match_total_correlation(panel: DataFrame, players: DataFrame,
                            matches: DataFrame) -> DataFrame:
    own = team_totals(panel, players)
    home = own.select("gw", F.col("team_code").alias("home_team"),
                      F.col("own_total").alias("home_pts"))
    away = own.select("gw", F.col("team_code").alias("away_team"),
                      F.col("own_total").alias("away_pts"))
    return (matches.select("gw", "home_team", "away_team").join(home, ["gw", "home_team"])
            .join(away, ["gw", "away_team"])
            .agg(X.correlation("home_pts", "away_pts").alias("r"), F.count(F.lit(1)).alias("n")))


def _club_states(matches: DataFrame) -> DataFrame:
    """Number of matches per (period, club, own bin, conceded bin)."""
    sides = matches.select("gw", F.explode(F.array(
        F.struct(F.col("home_team").alias("t"), F.col("home_score").alias("g"),
                 F.col("away_score").alias("c")),
        F.struct(F.col("away_team").alias("t"), F.col("away_score").alias("g"),
                 F.col("home_score").alias("c")))).alias("s"))
    return (sides.select("gw", F.col("s.t").alias("team_code"),
                         X.own_bin("s.g").alias("own_bin"),
                         X.conceded_bin("s.c").alias("conceded_bin")).dropna()
            .groupBy("gw", "team_code", "own_bin", "conceded_bin")
            .agg(F.count(F.lit(1)).alias("k")))


def _outcomes(rows: DataFrame, states: DataFrame, keys: Sequence[str],
              value: str) -> DataFrame:
    base = [k for k in keys if k in rows.columns]
    counts = rows.groupBy("gw", "team_code", *base, value).agg(F.count(F.lit(1)).alias("m"))
    cells = (counts.join(states, ["gw", "team_code"]).groupBy(*keys, value)
             .agg(F.sum(F.col("m") * F.col("k")).alias("n")))
    totals = cells.groupBy(*keys).agg(
        F.sum("n").alias("state_n"),
        (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("state_mean"))
    return cells.join(totals, list(keys)).select(*keys, value, "n", "state_n", "state_mean")


def outcome_tables(panel: DataFrame, players: DataFrame, matches: DataFrame,
                   value: str = "total_points") -> tuple[DataFrame, DataFrame]:
    """Outcomes given (position, own bin, conceded bin), and outcomes per entity.

    Each outcome is kept with its count instead of gathering a state's rows into one
    list; rows and matches of one club and period meet as counts.
    """
    rows = panel.join(players.select("player_id", "player_code", "position", "team_code"),
                      "player_id")
    states = _club_states(matches)
    any_state = states.groupBy("gw", "team_code").agg(F.sum("k").alias("k"))
    return (_outcomes(rows, states, ["position", "own_bin", "conceded_bin"], value),
            _outcomes(rows, any_state, ["player_code"], value))


def goal_states(matches: DataFrame) -> DataFrame:
    """Score lines of finished matches with their number."""
    return (matches.where(F.col("finished")).select("home_score", "away_score").dropna()
            .groupBy("home_score", "away_score").agg(F.count(F.lit(1)).alias("n")))


def sampling_summary(draws: DataFrame, value: str, levels: Sequence[float],
                     names: Sequence[str], thresholds: Sequence[float] = (80.0, 90.0)) -> DataFrame:
    """Mean, population spread, quantiles and tail shares as (stat, value) rows."""
    q = scale.exact_quantiles(draws, [], value, levels, "q").scalar()
    one = draws.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.avg((F.col(value) >= t).cast("double")).alias(f"p_ge_{t:g}") for t in thresholds])
    wide = one.select("mean", "std",
                      *[F.get(q, F.lit(i)).alias(n) for i, n in enumerate(names)],
                      *[f"`p_ge_{t:g}`" for t in thresholds])
    return wide.unpivot([], list(wide.columns), "stat", "value")


def histogram(df: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """Equal-width bins from the lowest to the highest value, the last one closed."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    index = F.least(F.floor((F.col(value) - lo) * bins / (hi - lo)), F.lit(bins - 1))
    counts = (df.where(F.col(value).isNotNull()).groupBy(index.cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    every = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
                        "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def mean_vectors(vectors: DataFrame, players: DataFrame, size: int = 9) -> DataFrame:
    """Mean quantile vector per entity, else of its position, centred on ``expected``.

    ``players`` holds (player_code, position, expected); the vector's own median is its
    centre where there is no expectation.
    """
    parts = lambda p: [F.avg(F.get("vector", F.lit(i))).alias(f"{p}{i}") for i in range(size)]
    by_code = vectors.groupBy("player_code").agg(*parts("c"))
    by_position = vectors.groupBy("position").agg(*parts("p"))
    joined = players.join(by_code, "player_code", "left").join(by_position, "position", "left")
    direct = F.col("c0").isNotNull()
    q = F.array(*[F.when(direct, F.col(f"c{i}")).otherwise(
        F.coalesce(f"p{i}", F.coalesce("expected", F.lit(0.0)))) for i in range(size)])
    middle = F.get(F.col("q"), F.lit(size // 2))
    return joined.withColumn("q", q).select(
        "player_code", "position", direct.alias("direct"),
        F.transform("q", lambda v: v + (F.coalesce("expected", middle) - middle))
        .alias("vector"))
