"""Season folders of CSV files to typed tables, and the parquet tables made of them.

Two layouts share one output. The newer one has a folder per period,
``By Gameweek/GW{n}/{table}.csv``, next to per-season files; the older one has a folder
per table. Files of equal headers are one scan; the period comes from the folder name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark import schemas as S
from panelspark.functions import scalar as X
from panelspark.operators import panel as P

ORDER = ("__folder_gw", "__file", "__block", "__row")
LINE = 24   # bytes of a short line of a statistics file: sizes of files to numbers of rows
TABLES = ("players", "teams", "gw_stats", "match_stats", "matches", "team_history")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _files(spark: SparkSession, path: str) -> list[Row]:
    """Files in order with their first line and bytes; one line for each comes to the driver.

    Files without bytes have no line and are left out.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    first = (lines.where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("file"), "value",
                     F.monotonically_increasing_id().alias("row"),
                     F.col("_metadata.file_size").alias("size"))
             .groupBy("file").agg(F.min_by("value", "row").alias("header"),
                                  F.max("size").alias("size")))
    return sorted(row for row in first.collect() if row.header.strip())


def read_csv(spark: SparkSession, path: str) -> list[DataFrame]:
    """All columns as text plus the place of each row; one frame for each different header.

    A file may be read in several splits: rows are ordered by folder period, file, start
    of the split, and position within it. Columns go by each file's own header.
    """
    return _read_sized(spark, path)[0]


def _read_sized(spark: SparkSession, path: str) -> tuple[list[DataFrame], int]:
    """The frames of :func:`read_csv` and the bytes of their files."""
    files = _files(spark, path)
    if not files:
        return [], 0
    # Files by number: their long names would go through every shuffle of the rows.
    numbers = F.broadcast(spark.createDataFrame(
        [(f.file, i) for i, f in enumerate(files)], "__path string, __file long"))
    by_header: dict[str, list[str]] = {}
    for f in files:
        by_header.setdefault(f.header, []).append(unquote(f.file))
    frames = [
        spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
        .csv(names).select(
            "*", F.expr(
                r"try_cast(regexp_extract(_metadata.file_path, '/GW([0-9]+)/', 1) AS bigint)")
            .alias("__folder_gw"),
            F.col("_metadata.file_path").alias("__path"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__row"))
        .join(numbers, "__path", "left").drop("__path")
        for names in by_header.values()]
    return frames, sum(f.size for f in files)


def _typed(name: str, dtype: T.DataType) -> Column:
    """Text to the contract type; whole numbers may be written as ``43.0``."""
    if isinstance(dtype, T.LongType):
        return F.col(name).cast("double").cast("bigint")
    return F.col(name).cast(dtype)


def _shape(raw: DataFrame, schema: T.StructType, rename: Mapping[str, str] | None = None,
           computed: Mapping[str, Column] | None = None) -> DataFrame:
    """Contract columns in contract order; absent ones as typed nulls when allowed."""
    raw = raw.withColumnsRenamed(dict(rename or {}))
    computed = dict(computed or {})
    cols = [computed.get(f.name, _typed(f.name, f.dataType)).alias(f.name)
            for f in schema.fields]
    return raw.select(*cols, *ORDER)


def players_from(raw: DataFrame) -> DataFrame:
    return _shape(raw, S.PLAYERS, computed={"position": X.position_word("position")})


def teams_from(raw: DataFrame) -> DataFrame:
    return _shape(raw, S.TEAMS)


def gw_stats_from(raw: DataFrame) -> DataFrame:
    """Panel rows; a zero official forecast of an available entity that is expected to
    play this period is replaced by this period's forecast."""
    out = _shape(raw, S.GW_STATS, {"id": "player_id"})
    broken = (F.col("status") == "a") & (F.col("ep_this") > 0) & (F.col("ep_next") == 0)
    return out.withColumn("ep_next", F.when(broken, F.col("ep_this"))
                          .otherwise(F.col("ep_next")))


def legacy_gw_stats_from(raw: DataFrame) -> DataFrame:
    """Older panel: the per-period points replace the running total; columns the layout
    does not have are typed nulls."""
    computed = {"total_points": _typed("event_points", T.LongType())}
    for f in S.GW_STATS.fields:
        if f.name not in raw.columns and f.name not in ("player_id", "total_points"):
            computed[f.name] = F.lit(None).cast(f.dataType)
    return _shape(raw, S.GW_STATS, {"id": "player_id"}, computed)


def match_stats_from(raw: DataFrame) -> DataFrame:
    return _shape(raw, S.MATCH_STATS).withColumn("gw", F.col("__folder_gw"))


def matches_from(raw: DataFrame) -> DataFrame:
    computed = {} if "tournament" in raw.columns else {"tournament": F.lit("prem")}
    return _shape(raw, S.MATCHES, {"gameweek": "gw"}, computed)


def team_history_from(raw: DataFrame) -> DataFrame:
    return _shape(raw, S.TEAM_HISTORY)


def detect_layout(season_dir: str, spark: SparkSession | None = None) -> str:
    """`modern` or `legacy`, by the folders there; the path may be of any file system."""
    spark = spark or SparkSession.active()
    if exists(spark, f"{season_dir}/By Gameweek"):
        return "modern"
    if all(exists(spark, f"{season_dir}/{d}") for d in ("players", "matches")):
        return "legacy"
    raise ValueError(f"unknown season layout in {season_dir}")


# Places of the tables in each layout, and the reader of each.
MODERN = {
    "players": ("players.csv", players_from),
    "teams": ("teams.csv", teams_from),
    "gw_stats": ("By Gameweek/GW[0-9]*/player_gameweek_stats.csv", gw_stats_from),
    "match_stats": ("By Gameweek/GW[0-9]*/playermatchstats.csv", match_stats_from),
    "matches": ("By Gameweek/GW[0-9]*/matches.csv", matches_from),
    "team_history": ("team_history.csv", team_history_from),
}
LEGACY = {
    "players": ("players/players.csv", players_from),
    "teams": ("teams/teams.csv", teams_from),
    "gw_stats": ("playerstats/playerstats.csv", legacy_gw_stats_from),
    "match_stats": ("playermatchstats/GW[0-9]*/playermatchstats.csv", match_stats_from),
    "matches": ("matches/GW[0-9]*/matches.csv", matches_from),
    "team_history": (None, team_history_from),
}


# Contract schemas of the stored tables; the season is their partition.
STORED = {"players": S.PLAYERS, "teams": S.TEAMS, "gw_stats": S.GW_STATS,
          "match_stats": T.StructType([*S.MATCH_STATS.fields,
                                       T.StructField("gw", T.LongType())]),
          "matches": S.MATCHES, "team_history": S.TEAM_HISTORY}


def _empty(spark: SparkSession, schema: T.StructType, season: str) -> DataFrame:
    return spark.createDataFrame([], schema).withColumn("season", F.lit(season))


def load_season(spark: SparkSession, root: str, season: str,
                tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Tables of one season (all unless named), repeated records removed.

    Statistics keep the row of the folder where a record first appeared; matches keep the
    last one, since a postponed match comes again with its final score. Only the files of
    the tables asked for are listed and read.
    """
    season_dir = f"{root}/{season}"
    layout = MODERN if detect_layout(season_dir, spark) == "modern" else LEGACY
    out = {}
    for table in tables:
        pattern, reader = layout[table]
        parts, size = (_read_sized(spark, f"{season_dir}/{pattern}") if pattern
                       else ([], 0))
        if not parts:
            if table in ("players", "teams"):
                raise FileNotFoundError(f"{season_dir}/{pattern}")
            out[table] = _empty(spark, STORED[table], season)
            continue
        rows = reduce(DataFrame.unionByName, map(reader, parts))
        if table in ("gw_stats", "match_stats", "matches"):
            keys = [k for k in S.KEYS[table] if k != "season"]
            rows = P.union_keep([rows], keys, ORDER, "last" if table == "matches" else "first",
                                rows=size // LINE)
        out[table] = rows.drop(*ORDER).withColumn("season", F.lit(season))
    return out


def write_tables(tables: Mapping[str, DataFrame], processed: str, season: str) -> None:
    """The season's partition of each table, replaced as a whole, also by no rows."""
    for name, df in tables.items():
        df.where(F.col("season") == season).drop("season").write.mode("overwrite").parquet(
            f"{processed}/{name}/season={season}")


def ingest(spark: SparkSession, root: str, seasons: Sequence[str], processed: str) -> None:
    for season in seasons:
        write_tables(load_season(spark, root, season), processed, season)


def read_table(spark: SparkSession, processed: str, table: str,
               seasons: Sequence[str] | None = None) -> DataFrame:
    """A processed table; a season filter reads only those partitions."""
    reader = spark.read
    if table in STORED:
        reader = reader.schema(T.StructType([*STORED[table].fields,
                                             T.StructField("season", T.StringType())]))
    df = reader.parquet(f"{processed}/{table}").withColumn(
        "season", F.col("season").cast("string"))
    return df if seasons is None else df.where(F.col("season").isin(list(seasons)))


def write_features(spark: SparkSession, processed: str, seasons: Sequence[str]) -> None:
    """Feature store per season; each season's last form seeds the next one."""
    carry = None
    for season in seasons:
        t = {n: read_table(spark, processed, n, [season]) for n in
             ("gw_stats", "team_history", "matches", "players")}
        features = P.build_features(t["gw_stats"], t["team_history"], t["matches"],
                                    t["players"], carry).withColumn("season", F.lit(season))
        write_tables({"features": features}, processed, season)
        carry = P.carryover_seed(read_table(spark, processed, "features", [season]))


def load_training(spark: SparkSession, processed: str, seasons: Sequence[str],
                  require_target: bool = True) -> DataFrame:
    """Model rows of several seasons, each joined with its own season's tables."""
    out = None
    for season in seasons:
        t = {n: read_table(spark, processed, n, [season]).drop("season") for n in
             ("features", "players", "gw_stats")}
        rows = P.model_rows(t["features"], t["players"], t["gw_stats"], season=season,
                            require_target=require_target)
        out = rows if out is None else out.unionByName(rows)
    return out
