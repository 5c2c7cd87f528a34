"""Squads against each other: totals, round-robin records, expected records."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import scalar as X
from panelspark.operators import scale
from panelspark.session import stored


def squad_gw_totals(basket: DataFrame, per_gw: DataFrame) -> DataFrame:
    """Expected total and member count per squad and period."""
    return (basket.select("team_id", "player_code")
            .join(per_gw.select("player_code", "gw", "expected_points"), "player_code")
            .groupBy("team_id", "gw")
            .agg(F.sum("expected_points").alias("gw_total"),
                 F.count("player_code").alias("n_players")))


def round_robin(gw_totals: DataFrame) -> DataFrame:
    """Record of every squad against every other squad of its periods, without pairs.

    A squad beats the totals below its own, so wins, draws and losses follow from its
    rank in the period. With d the distance to the period mean, the edges over n squads
    sum to n*d and their squares to n*d*d + n*variance.
    """
    ranked = scale.with_value_ranks(
        gw_totals.select("team_id", "gw", "gw_total"), ["gw"], "gw_total", "r")
    moments = gw_totals.groupBy("gw").agg(
        F.avg("gw_total").alias("mu"), F.var_pop("gw_total").alias("var"),
        F.count("gw_total").alias("n"))
    d = F.col("gw_total") - F.col("mu")
    rows = ranked.join(moments, "gw").select(
        "team_id",
        (F.col("n") - 1).alias("played"),
        F.col("r_before").alias("wins"),
        (F.col("n") - F.col("r_before") - F.col("r_eq")).alias("losses"),
        (F.col("r_eq") - 1).alias("draws"),
        (F.col("n") * d).alias("edge"),
        (F.col("n") * d * d + F.col("n") * F.col("var")).alias("edge_sq"))
    sums = rows.groupBy("team_id").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])
    p = F.col("played")
    spread = F.col("edge_sq") - F.col("edge") * F.col("edge") / p
    return sums.where(p > 0).select(
        "team_id", "played", "wins", "losses", "draws",
        (F.col("edge") / p).alias("avg_edge"),
        F.when(p > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (p - 1))).alias("edge_std"),
        ((F.col("wins") + 0.5 * F.col("draws")) / p).alias("win_ratio"))


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """:func:`panelspark.functions.scalar.normal_cdf` of an array, for checks."""
    a = np.abs(x)
    density = np.exp(-a * a / 2.0)
    body = density * X.horner(a, X.NORMAL_NUMERATOR) / X.horner(a, X.NORMAL_DENOMINATOR)
    chain = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    upper = np.where(a < X.TAIL_START, body, density / chain / X.SQRT_TWO_PI)
    return np.where(x > 0, 1.0 - upper, upper)


# Fixed values of the series in expected_record.
ORDER = 30             # highest derivative that is kept
SPREAD_RATIO = 1.1     # variances of one class lie within this factor
CERTAIN = 8.3          # standard deviations beyond which a win is certain in double precision
NO_SPREAD = 2.0 ** -40  # spreads below this share of the period's largest mean count as none
STEP = -100_000        # level of the pairs in which neither side has a spread


def _recurrence(df: DataFrame, prefix: str, step: Callable[[int, str, str], str]) -> DataFrame:
    """Columns ``prefix``2 to ``prefix``ORDER, each from the two before it.

    Four at a time: their shared parts are worked out once, and expressions stay short. They are
    SQL text, since a call for each of some hundred terms costs more than running them.
    """
    for low in range(1, ORDER, 4):
        before, last = f"{prefix}{low - 1}", f"{prefix}{low}"
        new = {}
        for k in range(low, min(low + 4, ORDER)):
            before, last = last, f"({step(k, last, before)})"
            new[f"{prefix}{k + 1}"] = F.expr(last)
        df = df.withColumns(new)
    return df


def _with_series(df: DataFrame) -> DataFrame:
    """Coefficients ``h0`` to ``hORDER`` of exp(x t + u t^2 / 2) in t, from columns x and u."""
    df = df.withColumns({"h0": F.lit(1.0), "h1": F.col("x")})
    return _recurrence(df, "h", lambda k, h, g: f"(x * {h} + u * {g}) / {k + 1}d")


def _with_derivatives(df: DataFrame) -> DataFrame:
    """``d0`` to ``dORDER``: Phi(d / sqrt(v)) and its derivatives by d, from columns d and v."""
    df = df.withColumn("z", F.col("d") / F.sqrt("v")).withColumns({
        "d0": X.normal_cdf(F.col("z")), "d1": X.normal_pdf(F.col("z")) / F.sqrt("v"),
        "slope": -F.col("d") / F.col("v")})
    return _recurrence(df, "d", lambda k, d, c: f"slope * {d} - {k - 1}d / v * {c}")


def _dot(left: str, right: str, shift: int = 0) -> str:
    """Sum of ``left``i times ``right``(i + shift) over the orders that both have."""
    return " + ".join(f"{left}{i} * {right}{i + shift}" for i in range(ORDER + 1 - shift))


def _with_spread(rows: DataFrame) -> DataFrame:
    """The variance ``u`` of each row, 0 for a spread that counts as none beside the ``top``."""
    spread = F.col("sample_std")
    return rows.withColumn("u", F.when(spread > F.col("top") * NO_SPREAD, spread * spread)
                           .otherwise(0.0))


def _class_pairs(classed: DataFrame) -> DataFrame:
    """Per period and two classes: the box width 2^level, the joint variance, the near range."""
    centres = classed.groupBy("gw", "class").agg(
        ((F.min("u") + F.max("u")) / 2).alias("centre"))
    own = centres.select("gw", F.col("class").alias("a"), F.col("centre").alias("ca"))
    rival = centres.select("gw", F.col("class").alias("b"), F.col("centre").alias("cb"))
    v = F.col("ca") + F.col("cb")
    level = F.when(v > 0, F.floor(F.log2(v) / 2).cast("int")).otherwise(F.lit(STEP))
    width = F.when(v > 0, F.pow(F.lit(2.0), F.col("level")))
    scaled = v / (F.col("width") * F.col("width"))
    near = F.ceil(CERTAIN * F.sqrt(scaled * ((1 + SPREAD_RATIO) / 2))).cast("bigint") + 1
    return (own.join(rival, "gw").withColumn("level", level).withColumn("width", width)
            .withColumn("v", scaled).withColumn("near", near))


def expected_record(squad_dist: DataFrame) -> DataFrame:
    """Expected round-robin record from a mean and a spread per squad and period, without pairs.

    A fast Gauss transform. Squads of a period fall into classes of near-equal variance, and for
    two classes the means into boxes about as wide as the joint spread. By the heat equation a
    change of variance acts as a second derivative by the mean, so one series in derivatives of
    the normal distribution function holds offsets of means and variances alike: a box of rivals
    is ORDER + 1 sums, two near boxes meet as one row, and a squad reads the series of its box.
    Rivals in boxes far below are won for certain and only counted; two squads without spread
    compare their means by rank. The error of one pairing is below 1e-12 (bound worked out in
    ``tests/test_expected_record.py``).

    Work is (squads + boxes * near boxes) * classes. The boxes of a period follow from the range
    of its means in spreads, not from its squads; sums are formed before the shuffle, so a
    period may hold any share of all squads. Series are written and shuffled for boxes only: a
    squad goes to its boxes as a few numbers and gets its series there. Rows without a finite
    mean and spread are left out; a spread below NO_SPREAD of the period's largest mean counts
    as none.
    """
    top = float("inf")
    dist = stored(squad_dist.where((F.abs("sample_mean") < top) & (F.abs("sample_std") < top))
                  .select("team_id", "gw", "sample_mean", "sample_std"), "squad-rows")
    periods = stored(dist.groupBy("gw").agg(
        F.max(F.abs("sample_mean")).alias("top"), F.avg("sample_mean").alias("mu"),
        F.count(F.lit(1)).alias("n")), "periods")
    rows = _with_spread(dist.join(periods.select("gw", "top"), "gw"))
    cell = ["gw", "sample_mean", "u"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "class", F.when(F.col("u") > 0, F.floor(F.ln("u") / math.log(SPREAD_RATIO)).cast("int"))
        .otherwise(F.lit(STEP)))
    # Neighbours in one file, so that the sums of boxes below are formed before their shuffle.
    classed = stored(scale.running_before(
        cells, ["gw", "class"], [("sample_mean", "asc"), ("u", "asc")], {"n": "n"}),
        "squad-cells")
    pairs = stored(_class_pairs(classed), "class-pairs")   # a row for each two classes
    series = pairs.where(F.col("level") != STEP)
    m, orders = F.col("sample_mean"), range(ORDER + 1)

    def boxed(side: str, *keep: str) -> DataFrame:
        wanted = series.select("gw", F.col(side).alias("class"), *keep, "level",
                               "width").distinct()
        return classed.join(wanted, ["gw", "class"]).withColumn(
            "box", F.floor(m / F.col("width")).cast("double"))

    def with_series(df: DataFrame, centre: str, sign: int) -> DataFrame:
        return _with_series(df.withColumns({
            "x": sign * (m / F.col("width") - F.col("box") - 0.5),
            "u": (F.col("u") - F.col(centre)) / (F.col("width") * F.col("width"))}))

    rivals = with_series(boxed("b", "cb"), "cb", -1).withColumnRenamed("class", "b")
    held = stored(rivals.groupBy("gw", "b", "level", "box").agg(
        F.sum("n").alias("n"), *[F.expr(f"sum(n * h{k}) AS s{k}") for k in orders]),
        "rival-boxes")

    squads = boxed("a", "b", "ca", "v", "near").withColumnRenamed("class", "a")
    place = ["gw", "a", "b", "level", "box"]
    boxes = stored(squads.select(*place, "ca", "width", "v", "near").distinct(), "squad-boxes")
    step = F.explode(F.sequence(-F.col("near"), F.col("near")))
    met = _with_derivatives(
        boxes.withColumn("step", step).withColumn("own", F.col("box"))
        .withColumn("box", F.col("own") + F.col("step"))
        .join(held.drop("n"), ["gw", "b", "level", "box"])
        .withColumn("d", -F.col("step").cast("double")))
    local = met.groupBy("gw", "a", "b", "level", F.col("own").alias("box")).agg(
        *[F.expr(f"sum({_dot('s', 'd', k)}) AS l{k}") for k in orders])

    line, probe = ["gw", "b", "level"], F.col("box") - F.col("near")
    marks = (held.select(*line, F.col("box").alias("probe"), "n")
             .unionByName(boxes.select(*line, probe.alias("probe"),
                                       F.lit(0).cast("bigint").alias("n")).distinct())
             .groupBy(*line, "probe").agg(F.sum("n").alias("n")))
    below = scale.running_before(marks, line, "probe", {"n": "below"}).select(
        *line, "probe", "below_before")
    known = stored(boxes.withColumn("probe", probe).join(below, [*line, "probe"])
                   .join(local, place, "left")
                   .select(*place, "ca", "width", "below_before", *[f"l{k}" for k in orders]),
                   "box-series")

    near_and_far = F.col("below_before") + F.coalesce(F.expr(_dot("h", "l")), F.lit(0.0))
    won = with_series(squads.select(*place, m, "u", F.col("u").alias("variance"))
                      .join(known, place), "ca", 1).select(
        "gw", m, F.col("variance").alias("u"), near_and_far.alias("won"))
    flat = classed.where(F.col("class") == STEP).select(
        *cell, (F.col("n_before") + F.col("n") / 2.0).alias("won"))
    per_cell = won.unionByName(flat).groupBy(*cell).agg(F.sum("won").alias("wins"))
    out = (rows.drop("top", "sample_std").join(per_cell, cell)
           .join(periods.drop("top"), "gw").groupBy("team_id").agg(
        F.sum(F.col("n") - 1).alias("played"),
        F.sum(F.col("wins") - 0.5).alias("exp_wins"),      # without the meeting with itself
        F.sum(F.col("n") * (m - F.col("mu"))).alias("edge")))
    p = F.col("played")
    return out.where(p > 0).select(
        "team_id", "played", "exp_wins", (F.col("edge") / p).alias("avg_edge"),
        (F.col("exp_wins") / p).alias("win_ratio"))


def weaknesses(basket: DataFrame, gw_totals: DataFrame) -> DataFrame:
    """Window total, worst period (lowest one on a tie) and share of the best member."""
    totals = gw_totals.groupBy("team_id").agg(
        F.sum("gw_total").alias("window_total"), F.min("gw_total").alias("worst_gw_total"),
        F.min_by("gw", F.struct("gw_total", "gw")).alias("worst_gw"))
    star = basket.groupBy("team_id").agg(
        F.try_divide(F.max("expected_total"), F.sum("expected_total"))
        .alias("star_dependence"))
    return totals.join(star, "team_id").select(
        "team_id", "window_total", "worst_gw", "worst_gw_total", "star_dependence")


def best_team(table: DataFrame, by: str) -> DataFrame:
    """The team with the highest value (lowest id on a tie)."""
    return table.orderBy(F.col(by).desc_nulls_last(), "team_id").limit(1)


def distinct_squads(basket: DataFrame) -> DataFrame:
    """Number of different member sets, compared by size and two order-free hash sums."""
    members = basket.select("team_id", "player_code").distinct()
    marks = members.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("player_code").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit(7), "player_code").cast("decimal(38,0)")).alias("h2"))
    return marks.select("n", "h1", "h2").distinct().agg(
        F.count(F.lit(1)).alias("distinct_squads"))
