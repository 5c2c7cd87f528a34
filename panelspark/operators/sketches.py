"""Residual shapes as mergeable quantile sketches (KLL), and forecasts built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import quantiles as Q
from panelspark.operators import scale

SIGMA_FLOOR = 1e-4
SKETCH_K = 1000


def with_residual(df: DataFrame) -> DataFrame:
    """Standardised residual ``z`` of (actual, pred, sigma)."""
    return df.withColumn("z", (F.col("actual") - F.col("pred"))
                         / F.greatest("sigma", F.lit(SIGMA_FLOOR)))


def residual_sketch(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One bounded sketch of ``z`` per key, merged from partial sketches."""
    return df.groupBy(*keys).agg(
        F.call_function("kll_sketch_agg_double", F.col("z"), F.lit(SKETCH_K)).alias("sketch"),
        F.count("z").alias("n"))


def merge_sketches(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fold the sketches of new residuals into the stored ones."""
    both = old.select(*keys, "sketch", "n").unionByName(new.select(*keys, "sketch", "n"))
    return both.groupBy(*keys).agg(
        F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"),
        F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, levels: Sequence[float] = S.QS,
                     name: str = "z") -> DataFrame:
    return sketches.withColumn(name, F.array(*[
        F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(q)))
        for q in levels])).drop("sketch")


def exact_residual_quantiles(df: DataFrame, keys: Sequence[str] = (),
                             levels: Sequence[float] = S.QS) -> DataFrame:
    return scale.exact_quantiles(df, list(keys), "z", levels, "z_quantiles")


def quantile_forecast(scored: DataFrame, z: DataFrame, column: str = "z_quantiles",
                      clip: bool = False) -> DataFrame:
    """Vector ``pred + sigma * z`` per row of (player_code, gw, pred, sigma)."""
    shape = z.select(column).scalar()
    out = scored.withColumn("__z", shape).withColumn(
        "vector", Q.scaled_vector("pred", "sigma", "__z")).drop("__z")
    return out.withColumn("vector", Q.clipped("vector")) if clip else out


def percentile_of_actual(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Place of each result in its own forecast, with the surprise flags."""
    joined = rows.join(vectors.select("player_code", "gw", "vector"),
                       ["player_code", "gw"], "left")
    actual = F.coalesce(F.col("actual_points").cast("double"), F.lit(0.0))
    below = Q.probability_below("vector", "__actual")
    out = joined.withColumn("__actual", actual).withColumn(
        "__below", F.when(F.col("vector").isNotNull(), below))
    return out.withColumns({
        "percentile": F.bround(F.col("__below") * 100.0, 1),
        "p_exceed": F.bround(1.0 - F.col("__below"), 4),
        "surprise": F.when((F.col("__below") >= 0.95) & (F.col("__actual") >= 3), "beat_95th")
        .when(F.col("__below") <= 0.05, "below_5th"),
    }).drop("__actual", "__below", "vector")
