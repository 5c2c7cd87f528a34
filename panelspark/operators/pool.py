"""From scored entities to a bounded, diverse pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import scalar as X
from panelspark.operators import scale


def availability(gw_stats: DataFrame, players: DataFrame, gw_start: int,
                 gw_end: int) -> DataFrame:
    """Minutes and latest price per stable code over a window of periods."""
    return (
        gw_stats.where(F.col("gw").between(gw_start, gw_end))
        .join(players.select("player_id", "player_code"), "player_id")
        .groupBy("player_code")
        .agg(F.sum("minutes").alias("minutes_in_window"),
             F.max_by("now_cost", F.struct("gw", "player_id")).alias("now_cost")))


def drop_never_featuring(scored: DataFrame, available: DataFrame,
                         min_minutes: int = 0) -> DataFrame:
    side = available.where(F.col("minutes_in_window") > min_minutes)
    return scored.join(side.select("player_code", "minutes_in_window"), "player_code")


def within_average_rank(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Rows whose average descending rank within the group is at most ``k``.

    Only the ``k`` largest distinct values of a group can qualify, so each task keeps at
    most ``k`` cells per group before anything is shuffled.
    """
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__eq"))
    best = scale.top_n(cells, keys, [F.col(value).desc()], k)
    above = (Window.partitionBy(*keys).orderBy(F.col(value).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    kept = (best.withColumn("__above", F.coalesce(F.sum("__eq").over(above), F.lit(0)))
            .where(F.col("__above") + (F.col("__eq") + 1) / 2.0 <= k)
            .select(*keys, value))
    return df.join(kept, [*keys, value], "left_semi")


def filter_pool(scored: DataFrame, available: DataFrame, *, top_k_per_position: int = 30,
                max_per_team: int = 4, reserve_top: int = 20, min_price: float = 0.0,
                max_price: float = 100.0) -> DataFrame:
    """The overall best, plus the best per position, then per club among those."""
    side = (available.where((F.col("minutes_in_window") > 0)
                            & F.col("now_cost").between(min_price, max_price))
            .select("player_code", "minutes_in_window", "now_cost"))
    pool = scored.join(side, "player_code")
    reserved = pool.orderBy(F.col("expected_total").desc(), "player_code").limit(reserve_top)
    rest = pool.join(reserved.select("player_code"), "player_code", "left_anti")
    rest = within_average_rank(rest, ["position"], "expected_total", top_k_per_position)
    rest = within_average_rank(rest, ["team_code"], "expected_total", max_per_team)
    return reserved.unionByName(rest.select(*reserved.columns))


def players_frame(pool: DataFrame) -> DataFrame:
    return pool.select(
        F.col("player_code").cast("bigint"), F.col("web_name").cast("string"),
        F.col("position").cast("string"), F.col("team_code").cast("bigint"),
        X.to_tenths("now_cost").alias("price_tenths"))


def squad_for_price(pool: DataFrame) -> DataFrame:
    return pool.withColumns({"price_tenths": X.to_tenths("now_cost"),
                             "code_str": F.col("player_code").cast("string")})


def log10_choose(n: Column, k: int) -> Column:
    """log10 of n choose k as a sum of k logarithms (no large integers)."""
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.log10((n - k + i) / float(i))
    return out


def search_space_size(pool: DataFrame,
                      need: Mapping[str, int] = S.SQUAD_COUNTS) -> DataFrame:
    """log10 of the number of squads by position counts; too small a pool is an error."""
    counts = pool.agg(*[F.count_if(F.col("position") == p).alias(p) for p in need])
    terms = F.lit(0.0)
    for p, k in need.items():
        short = F.raise_error(F.concat(
            F.lit("pool has "), F.col(p).cast("string"), F.lit(f" {p} but need {k}")))
        terms = terms + F.when(F.col(p) < k, short.cast("double")).otherwise(
            log10_choose(F.col(p), k))
    return counts.select(*need, terms.alias("log10_teams"))


def ranked_page(df: DataFrame, sort: str | None, *, descending: bool = False,
                limit: int = 100, offset: int = 0, tie: str = "player_code",
                sortable: Sequence[str] | None = None) -> DataFrame:
    """One page of a sorted table, nulls last in both directions."""
    if sort is not None and sortable is not None and sort not in sortable:
        raise ValueError(f"cannot sort by {sort!r}")
    order = [F.col(tie).asc()]
    if sort is not None and sort in df.columns:
        first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
        order.insert(0, first)
    return df.orderBy(*order).offset(offset).limit(limit)
