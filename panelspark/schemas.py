"""Table schemas and the fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns])


LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

# Quantile levels of every stored distribution.
QS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
Q_NAMES = ("q1", "q5", "q10", "q25", "q50", "q75", "q90", "q95", "q99")
Q_NAMES_PADDED = ("q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99")

# Squad rules.
POSITIONS = ("GKP", "DEF", "MID", "FWD")
SQUAD_COUNTS = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
DEFAULT_XI = {"GKP": 1, "DEF": 4, "MID": 5, "FWD": 1}
XI_MINIMUMS = {"GKP": 1, "DEF": 3, "FWD": 1}
SQUAD_SIZE = 15
XI_SIZE = 11
BUDGET_TENTHS = 1000
MAX_PER_CLUB = 3
TENTHS_PER_MILLION = 10

# Position words in source files, and numeric element types.
POSITION_WORDS = {
    "Goalkeeper": "GKP",
    "Defender": "DEF",
    "Midfielder": "MID",
    "Forward": "FWD",
    "Unknown": "UNK",
}
ELEMENT_TYPES = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}

# Availability status letters.
STATUS_PLAYABLE = ("a", "d")
STATUS_OUT = ("i", "s", "u", "n")
STATUS_EXCLUDED = ("i", "s", "u")

PLAYERS = _table(
    ("player_code", LONG), ("player_id", LONG), ("first_name", STRING),
    ("second_name", STRING), ("web_name", STRING), ("team_code", LONG),
    ("position", STRING),
)
TEAMS = _table(
    ("code", LONG), ("id", LONG), ("name", STRING), ("short_name", STRING),
    ("strength", DOUBLE), ("elo", DOUBLE),
)
GW_STATS = _table(
    ("player_id", LONG), ("gw", LONG), ("web_name", STRING), ("second_name", STRING),
    ("status", STRING), ("total_points", LONG), ("minutes", LONG),
    ("goals_scored", LONG), ("assists", LONG), ("bonus", LONG), ("bps", LONG),
    ("saves", LONG), ("starts", LONG), ("now_cost", DOUBLE), ("form", DOUBLE),
    ("ep_next", DOUBLE), ("ep_this", DOUBLE), ("selected_by_percent", DOUBLE),
)
MATCH_STATS = _table(
    ("player_id", LONG), ("match_id", STRING), ("minutes_played", DOUBLE),
    ("goals", DOUBLE), ("assists", DOUBLE), ("xg", DOUBLE), ("xa", DOUBLE),
)
MATCHES = _table(
    ("match_id", STRING), ("gw", LONG), ("kickoff_time", STRING), ("home_team", LONG),
    ("away_team", LONG), ("home_score", LONG), ("away_score", LONG),
    ("home_team_elo", DOUBLE), ("away_team_elo", DOUBLE), ("tournament", STRING),
    ("finished", BOOL),
)
TEAM_HISTORY = _table(("player_id", LONG), ("gw", LONG), ("team_code", LONG))
FEATURE_COLUMNS = (
    "player_id", "player_code", "gw", "team_code", "opponent_team_code", "was_home",
    "home_elo", "opponent_elo", "prev_points", "pts_avg_3", "pts_avg_5",
    "total_points", "next_points",
)

# Natural keys used to remove repeated records.
KEYS = {
    "players": ("season", "player_code"),
    "teams": ("season", "code"),
    "gw_stats": ("season", "player_id", "gw"),
    "match_stats": ("season", "player_id", "match_id"),
    "matches": ("season", "match_id"),
    "team_history": ("season", "player_id", "gw"),
}

LIVE_ELEMENT = _table(
    ("id", LONG), ("code", LONG), ("web_name", STRING), ("team", LONG),
    ("team_code", LONG), ("element_type", LONG), ("now_cost", LONG),
    ("status", STRING), ("news", STRING), ("news_added", STRING),
    ("chance_of_playing_this_round", DOUBLE), ("chance_of_playing_next_round", DOUBLE),
    ("selected_by_percent", STRING), ("minutes", LONG), ("ep_next", STRING),
    ("ep_this", STRING), ("removed", BOOL), ("can_select", BOOL),
    ("can_transact", BOOL),
)
LIVE_TEAM = _table(("code", LONG), ("id", LONG), ("name", STRING), ("short_name", STRING))
