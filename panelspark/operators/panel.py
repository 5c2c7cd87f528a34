"""The entity-by-period panel: lagged features, fixture context, targets, horizons.

A panel has one row per (season-local id, period), so a window over one id holds at most
as many rows as there are periods, however large the source was before aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import scalar as X
from panelspark.operators import scale

FORM_COLUMNS = ("prev_points", "pts_avg_3", "pts_avg_5")


def _by_id(id_col: str = "player_id", time: str = "gw") -> Window:
    return Window.partitionBy(id_col).orderBy(time)


def trailing_features(panel: DataFrame, value: str = "total_points", *,
                      id_col: str = "player_id", time: str = "gw",
                      windows: Sequence[int] = (3, 5)) -> DataFrame:
    """Previous value, trailing means of earlier rows, next value.

    Row based: a missing period is bridged, the current row is never in its own mean.
    """
    w = _by_id(id_col, time)
    return panel.withColumns({
        "prev_points": F.lag(value).over(w),
        **{f"pts_avg_{n}": F.avg(value).over(w.rowsBetween(-n, -1)) for n in windows},
        "next_points": F.lead(value).over(w),
    })


def target_shift_violations(features: DataFrame) -> DataFrame:
    """Count of rows whose stored target is not the value of the id's next row."""
    expected = F.lead("total_points").over(_by_id())
    return (features.withColumn("expected_next", expected)
            .where(F.col("expected_next").isNotNull()
                   & (F.col("next_points") != F.col("expected_next")))
            .agg(F.count(F.lit(1)).alias("n")))


def role_rates(panel: DataFrame, *, span: int = 5, full_minutes: int = 90) -> DataFrame:
    """Share of appearances, starts and minutes in this and the previous rows.

    The divisors stay at the full span for entities with a short history.
    """
    w = _by_id().rowsBetween(-(span - 1), 0)
    minutes = F.coalesce(F.col("minutes").cast("double"), F.lit(0.0))
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, 1).otherwise(0)
    return panel.select(
        "player_id", "gw",
        (F.sum(flag("minutes")).over(w) / span).alias("appear_rate_5"),
        (F.sum(flag("starts")).over(w) / span).alias("start_rate_5"),
        (F.sum(F.least(minutes, F.lit(float(full_minutes)))).over(w)
         / float(span * full_minutes)).alias("minutes_share_5"),
    )


# --- fixtures ---------------------------------------------------------------

def both_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, home then away, from one scan."""
    def side(me: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(f"{me}_team").alias("team_code"),
            F.col(f"{other}_team").alias("opponent_team_code"),
            F.lit(home).alias("was_home"),
            F.col(f"{me}_team_elo").alias("home_elo"),
            F.col(f"{other}_team_elo").alias("opponent_elo"),
            F.col(f"{me}_score").alias("goals"),
            F.col(f"{other}_score").alias("conceded"),
        )

    return (matches.select(
        "gw", "match_id",
        F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s"))
        .select("gw", "match_id", "s.*"))


def fixture_context(matches: DataFrame, tournament: str | None = "prem") -> DataFrame:
    """One fixture per (period, club); of several, a home one, then the lowest match id."""
    source = matches if tournament is None else matches.where(F.col("tournament") == tournament)
    sides = both_sides(source)
    return scale.keep_one(
        sides, ["gw", "team_code"],
        [F.col("was_home").desc(), F.col("match_id").asc()],
    ).select("gw", "team_code", "opponent_team_code", "was_home", "home_elo", "opponent_elo")


def with_club(rows: DataFrame, team_history: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of (player_id, gw) with stable code and club: that of the period, else the last."""
    known = players.select("player_id", "player_code", F.col("team_code").alias("latest_club"))
    moved = team_history.select("player_id", "gw", F.col("team_code").alias("club_then"))
    return (rows.join(moved, ["player_id", "gw"], "left").join(known, "player_id", "left")
            .withColumn("team_code", F.coalesce("club_then", "latest_club"))
            .drop("club_then", "latest_club"))


def build_features(gw_stats: DataFrame, team_history: DataFrame, matches: DataFrame,
                   players: DataFrame, carryover: DataFrame | None = None) -> DataFrame:
    """One feature row per (id, period) of a season, with club, fixture, form and target."""
    rows = with_club(gw_stats.select("player_id", "gw", "total_points"), team_history, players)
    placed = trailing_features(rows.join(fixture_context(matches), ["gw", "team_code"], "left"))
    if carryover is not None:
        placed = apply_carryover(placed, carryover, gw_stats.agg(F.min("gw")).scalar())
    return placed.select(*S.FEATURE_COLUMNS).dropna(subset=list(FORM_COLUMNS))


def carryover_seed(features: DataFrame) -> DataFrame:
    """Last row per stable code: the form columns that seed the next season."""
    last = F.max_by(F.struct("pts_avg_3", "pts_avg_5", "prev_points"),
                    F.struct("gw", "player_id"))
    return (features.groupBy("player_code").agg(last.alias("s"))
            .select("player_code", "s.*"))


def apply_carryover(form: DataFrame, carryover: DataFrame, first_gw: Column) -> DataFrame:
    """Fill missing form in the season's first period only (one minimum for all ids)."""
    seed = carryover.select("player_code", F.struct(*FORM_COLUMNS).alias("seed"))
    opening = F.col("gw") == first_gw
    return form.join(seed, "player_code", "left").withColumns({
        name: F.coalesce(name, F.when(opening, F.col("seed")[name])) for name in FORM_COLUMNS
    }).drop("seed")


def model_rows(features: DataFrame, players: DataFrame, gw_stats: DataFrame, *,
               season: str = "unknown", require_target: bool = True) -> DataFrame:
    """Feature rows with position, price and official forecast, nulls made explicit."""
    had_match = F.col("opponent_team_code").isNotNull()
    rows = (
        features.join(players.select("player_code", "position"), "player_code", "left")
        .join(gw_stats.select("player_id", "gw", "now_cost", "ep_next"),
              ["player_id", "gw"], "left")
        .withColumn("had_match", had_match)
        .withColumn("was_home", F.when(had_match, F.col("was_home")).otherwise(F.lit(False)))
        .fillna(0.0, subset=["opponent_elo", "home_elo", "now_cost", "ep_next"])
        .withColumn("position_code", X.category_code("position"))
        .withColumn("season", F.lit(season))
    )
    return rows.where(F.col("next_points").isNotNull()) if require_target else rows


# --- forecasts over a horizon -------------------------------------------------

def horizon_scores(predictions: DataFrame, players: DataFrame, gw_start: int, gw_end: int,
                   codes: Sequence[int] | None = None) -> DataFrame:
    """Source row of period k serves period k + 1, for every period of the window.

    ``predictions`` holds (player_id, player_code, gw, pred). Club and name come from the
    entity table, not from the feature row.
    """
    rows = (
        predictions.where(F.col("gw").between(gw_start - 1, gw_end - 1))
        .select("player_id", "player_code", (F.col("gw") + 1).alias("gw"),
                F.bround("pred", 3).alias("expected_points"))
        .join(players.select("player_id", "player_code", "web_name", "position", "team_code"),
              ["player_id", "player_code"], "left")
        .select("player_code", "web_name", "position", "team_code", "gw", "expected_points")
    )
    return rows if codes is None else rows.where(F.col("player_code").isin(list(codes)))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def window_scores(horizon: DataFrame) -> DataFrame:
    """Total and mean expected points per entity over the window."""
    return horizon.groupBy("player_code", "web_name", "position", "team_code").agg(
        F.sum("expected_points").alias("expected_total"),
        F.avg("expected_points").alias("expected_mean_per_gw"))


class SchemaError(ValueError):
    """A frame does not have the columns of its kind."""


# Columns of each kind of forecast, and other names that a column may come under.
FORECAST_COLUMNS = {"point": ("player_code", "gw", "expected_points"),
                    "distribution": ("player_code", "gw", *S.Q_NAMES_PADDED)}
FORECAST_ALIASES = {"expected_points": "pred"}


def normalize_forecast(frame: DataFrame, kind: str = "point") -> DataFrame:
    """The columns of a kind of forecast in their order; anything else is an error."""
    have = set(frame.columns)
    try:
        found = {c: c if c in have else FORECAST_ALIASES.get(c) for c in FORECAST_COLUMNS[kind]}
    except KeyError as err:
        raise SchemaError(f"{kind!r} is none of {sorted(FORECAST_COLUMNS)}") from err
    lost = sorted(c for c, source in found.items() if source not in have)
    if lost:
        raise SchemaError(f"a {kind} forecast needs {', '.join(lost)}")
    return frame.select(*[F.col(source).alias(c) for c, source in found.items()])


# --- ordered union and removal of repeated records ----------------------------

def union_keep(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str],
               keep: str = "first", rows: int | None = None) -> DataFrame:
    """Union of the frames, one row per key: the first or last in ``order``.

    With a number of ``rows``, in as many tasks as they call for.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    if rows is None:
        return scale.keep_one(merged, keys, by)
    return scale.keep_one_dealt(merged, keys, by, order, rows)


def form_of_largest(panel: DataFrame, n: int = 5) -> DataFrame:
    """Mean of the ``n`` largest values per id (the form rule as the results compute it)."""
    best = scale.top_n(panel.where(F.col("total_points").isNotNull()), ["player_id"],
                       [F.col("total_points").desc(), F.col("gw").asc()], n)
    return best.groupBy("player_id").agg(F.avg("total_points").alias("form"))


def form_of_latest(panel: DataFrame, n: int = 5) -> DataFrame:
    """Mean of the latest ``n`` rows per id (the form rule as it is described)."""
    last = scale.top_n(panel, ["player_id"], [F.col("gw").desc()], n)
    return last.groupBy("player_id").agg(F.avg("total_points").alias("form"))


def latest_price(panel: DataFrame, up_to: int | None = None) -> DataFrame:
    """Price of the latest settled row per id."""
    settled = panel if up_to is None else panel.where(F.col("gw") <= up_to)
    return settled.groupBy("player_id").agg(F.max_by("now_cost", "gw").alias("now_cost"))


def clock(event_live: DataFrame | None, features: DataFrame) -> DataFrame:
    """Current period (settled, else features, else 0), the next one, the last scoreable one."""
    top = features.agg(F.max("gw").alias("f"))
    settled = event_live.agg(F.max("gw")).scalar() if event_live is not None \
        else F.lit(None).cast("bigint")
    current = F.coalesce(settled, F.col("f"), F.lit(0).cast("bigint"))
    return top.select(
        current.alias("current"), (current + 1).alias("next"),
        F.when(F.col("f").isNull(), F.lit(0)).otherwise(F.col("f") + 1)
        .cast("bigint").alias("scoreable"))
