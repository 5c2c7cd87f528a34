"""Written results: candidates, materialised forecasts, metric documents."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import quantiles as Q

CANDIDATE_COLUMNS = (
    "team_id", "player_code", "position", "price_tenths", "expected_total",
    "artifact_schema_version", "season", "gw_start", "gw_end", "model_id")


def validate_candidates(df: DataFrame) -> None:
    missing = sorted(set(CANDIDATE_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError("candidate artifact missing required columns: " + ", ".join(missing))


def ranked_candidates(basket: DataFrame, ranks: DataFrame, *, season: str, gw_start: int,
                      gw_end: int, model_id: str = "unknown") -> DataFrame:
    """Basket rows of the ranked teams, ready for later stages."""
    out = (basket.join(ranks.select("team_id", "candidate_rank"), "team_id")
           .withColumns({
               "artifact_schema_version": F.lit(1), "season": F.lit(season),
               "gw_start": F.lit(gw_start), "gw_end": F.lit(gw_end),
               "model_id": F.lit(model_id)}))
    validate_candidates(out)
    return out


def write_forecast(forecast: DataFrame, path: str, season: str, gw_start: int,
                   gw_end: int) -> None:
    """Materialise a forecast window: quantiles as columns, none below 0.

    ``forecast`` holds (player_code, web_name, position, gw, pred, vector).
    """
    if not 0 <= gw_end - gw_start <= 10:
        raise ValueError("forecast window must span 1..11 gameweeks")
    flat = forecast.withColumn("q", Q.to_struct(Q.clipped("vector"))).select(
        *[c for c in forecast.columns if c != "vector"], "q.*")
    (flat.withColumns({"season": F.lit(season), "gw_start": F.lit(gw_start),
                       "gw_end": F.lit(gw_end)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season", "gw_start", "gw_end").parquet(path))


def read_forecast(spark: SparkSession, path: str, season: str, gw_start: int, gw_end: int, *,
                  codes: Sequence[int] | None = None,
                  position: str | None = None) -> DataFrame:
    """Rows of a materialised window; only its partition is read."""
    if not 0 <= gw_end - gw_start <= 10:
        raise ValueError("forecast window must span 1..11 gameweeks")
    df = spark.read.parquet(path).where(
        (F.col("season") == season) & (F.col("gw_start") == gw_start)
        & (F.col("gw_end") == gw_end))
    if codes is not None:
        df = df.where(F.col("player_code").isin(list(codes)))
    return df if position is None else df.where(F.col("position") == position)


def write_collected(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def write_json(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results as (name, metric, value), metrics named like ``mae@all``.

    Documents hold ``results`` with ``name``, cohort ``metrics`` and the ``ranking`` and
    ``calibration`` maps, and ``gym.runs`` with ``totals``.
    """
    numbers = "map<string,double>"
    schema = ("results array<struct<name:string, metrics:array<map<string,string>>, "
              f"ranking:{numbers}, calibration:{numbers}, "
              "gym:struct<runs:array<struct<totals:map<string,string>>>>>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    result = docs.select(F.explode("results").alias("r")).select("r.*")

    def named(entries: Column, name: Callable[[Column], Column], *skip: str) -> Column:
        """(metric, value as text) of the entries of a map, but for the keys to skip."""
        return F.transform(F.filter(F.map_entries(entries), lambda e: ~e["key"].isin(*skip)),
                           lambda e: F.struct(name(e["key"]).alias("metric"),
                                              e["value"].cast("string").alias("value")))

    def prefixed(prefix: str) -> Callable[[Column], Column]:
        return lambda key: F.concat(F.lit(prefix), key)

    def in_cohort(m: Column) -> Column:
        cohort = F.coalesce(m["cohort"], F.lit("all"))
        return named(m, lambda key: F.concat_ws("@", key, cohort), "cohort", "n")

    # The prefixes of the sections and the entries that are no metrics.
    parts = [F.flatten(F.transform("metrics", in_cohort)),
             F.flatten(F.transform("gym.runs", lambda g: named(
                 g["totals"], prefixed("gym@"), "settlement"))),
             named(F.col("ranking"), prefixed("rank@"), "n"),
             named(F.col("calibration"), prefixed("cal@"), "n")]
    every = F.concat(*[F.coalesce(p, F.array()) for p in parts])
    return (result.select(F.coalesce("name", F.lit("?")).alias("name"),
                          F.explode(every).alias("e"))
            .select("name", "e.metric", F.expr("try_cast(e.value AS double)").alias("value"))
            .where(F.col("value").isNotNull()))


def compare_results(long: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per experiment, one column per metric (missing ones null, of several the largest)."""
    pivot = long.groupBy("name").pivot("metric", list(metrics)) if metrics else \
        long.groupBy("name").pivot("metric")
    return pivot.agg(F.max("value"))
