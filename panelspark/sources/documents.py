"""Landed JSON documents: the live snapshot and the collected league, as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark import schemas as S

CORRUPT = "_corrupt_record"

# Columns of the snapshot table, in order.
LIVE_COLUMNS = (
    "player_code", "player_id", "web_name", "team_code", "element_type", "now_cost",
    "status", "news", "news_added", "chance_of_playing_this_round",
    "chance_of_playing_next_round", "selected_by_percent", "minutes", "ep_next",
    "ep_this", "removed", "can_select", "can_transact")

SNAPSHOT = T.StructType([
    T.StructField("payload", T.StructType([
        T.StructField("elements", T.ArrayType(S.LIVE_ELEMENT)),
        T.StructField("teams", T.ArrayType(S.LIVE_TEAM))])),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("fetched_epoch", T.DoubleType()),
    T.StructField(CORRUPT, T.StringType())])

HISTORY = ("event", "points", "total_points", "rank", "points_on_bench", "event_transfers")


def file_name() -> Column:
    return F.col("_metadata.file_name")


def number_in_name(pattern: str, name: str | Column = "file") -> Column:
    """Number a file name holds; the name decides, not the time of the file."""
    c = F.col(name) if isinstance(name, str) else name
    text = F.regexp_extract(c, pattern, 1)
    return F.when(text != "", text).cast("bigint")


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Whole-file JSON documents with their file name; None when no file matches.

    A broken document is a row whose corrupt column is set; it is removed here, so it
    counts as missing.
    """
    if CORRUPT not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    try:
        docs = (spark.read.schema(schema).option("multiLine", True)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                .json(path))
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return (docs.select("*", file_name().alias("file"))
            .where(F.col(CORRUPT).isNull()).drop(CORRUPT))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """Snapshot documents that are whole; missing or broken ones give no rows."""
    docs = read_json(spark, path, SNAPSHOT)
    if docs is None:
        return None
    return docs.where(F.col("payload").isNotNull() & F.col("fetched_at").isNotNull()
                      & F.col("fetched_epoch").isNotNull())


def live_frame(snapshot: DataFrame) -> DataFrame:
    """One row per element, keyed by the stable code; prices stay in tenths."""
    rows = snapshot.select(F.explode("payload.elements").alias("e")).select("e.*")
    return (rows.withColumnRenamed("code", "player_code").withColumnRenamed("id", "player_id")
            .select(*LIVE_COLUMNS))


def live_teams(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.explode("payload.teams").alias("t")).select("t.*")


def read_history(spark: SparkSession, path: str,
                 entry_pattern: str = r"entry_(\d+)_history") -> DataFrame | None:
    """Rows of ``current`` of every history document, with the entry from the file name."""
    schema = T.StructType([T.StructField("current", T.ArrayType(
        T.StructType(_longs(*HISTORY))))])
    docs = read_json(spark, path, schema)
    return None if docs is None else docs.select(
        number_in_name(entry_pattern).alias("entry_id"), F.explode("current").alias("r")
    ).select("entry_id", "r.*")


def read_picks(spark: SparkSession, path: str, entry_pattern: str = r"entry_(\d+)_",
               gw_pattern: str = r"gw(\d+)_picks") -> DataFrame | None:
    pick = T.StructType([
        *_longs("element", "position", "multiplier"),
        T.StructField("is_captain", T.BooleanType()),
        T.StructField("is_vice_captain", T.BooleanType()), *_longs("element_type")])
    docs = read_json(spark, path, T.StructType([T.StructField("picks", T.ArrayType(pick))]))
    return None if docs is None else docs.select(
        number_in_name(entry_pattern).alias("entry_id"),
        number_in_name(gw_pattern).alias("gw"), F.explode("picks").alias("r")
    ).select("entry_id", "gw", "r.*")


def read_event_live(spark: SparkSession, path: str,
                    gw_pattern: str = r"gw(\d+)_live") -> DataFrame | None:
    """Elements of every event document with their statistics as columns."""
    stats = T.StructType(_longs("minutes", "total_points", "goals_scored", "assists",
                                "bonus", "bps", "saves", "starts"))
    element = T.StructType([*_longs("id"), T.StructField("stats", stats)])
    docs = read_json(spark, path, T.StructType([
        T.StructField("elements", T.ArrayType(element))]))
    return None if docs is None else docs.select(
        number_in_name(gw_pattern).alias("gw"), F.explode("elements").alias("e")
    ).select("gw", F.col("e.id").alias("player_id"), "e.stats.*")


def read_standings(spark: SparkSession, path: str, league_id: int) -> DataFrame | None:
    """Result rows of all pages; rows without an entry are left out."""
    row = T.StructType([
        *_longs("entry", "rank"), T.StructField("player_name", T.StringType()),
        T.StructField("entry_name", T.StringType()),
        *_longs("total", "event_total", "last_rank")])
    docs = read_json(spark, path, T.StructType([T.StructField("standings", T.StructType([
        T.StructField("results", T.ArrayType(row))]))]))
    return None if docs is None else (
        docs.select(F.explode("standings.results").alias("r")).select("r.*")
        .where(F.col("entry").isNotNull())
        .select(F.lit(league_id).cast("bigint").alias("league_id"),
                F.col("entry").alias("entry_id"), "rank", "player_name", "entry_name",
                "total", "event_total", "last_rank"))


def read_matches(spark: SparkSession, path: str) -> DataFrame | None:
    row = T.StructType([
        *_longs("event", "entry_1_entry", "entry_1_points", "entry_2_entry",
                "entry_2_points"),
        T.StructField("is_bye", T.BooleanType())])
    docs = read_json(spark, path, T.StructType([T.StructField("results",
                                                              T.ArrayType(row))]))
    return None if docs is None else docs.select(F.explode("results").alias("r")).select("r.*")


def read_entry(spark: SparkSession, path: str) -> DataFrame | None:
    """Own entry id from either document shape."""
    schema = T.StructType([*_longs("entry_id"), T.StructField(
        "entry", T.StructType(_longs("id")))])
    docs = read_json(spark, path, schema)
    return None if docs is None else docs.select(
        F.coalesce("entry_id", "entry.id").alias("entry_id"))


def newest(docs: DataFrame, pattern: str = r"gw(\d+)_") -> DataFrame:
    """The document with the highest number in its name (gw12 is newer than gw5)."""
    return (docs.withColumn("__n", number_in_name(pattern)).where(F.col("__n").isNotNull())
            .orderBy(F.col("__n").desc(), "file").limit(1).drop("__n"))


def in_name_order(docs: DataFrame, pattern: str = r"gw(\d+)_") -> DataFrame:
    return docs.orderBy(number_in_name(pattern), "file")


OPTION = T.StructType([
    T.StructField("transfer_in", T.StringType()), T.StructField("transfer_out", T.StringType()),
    *_longs("transfer_in_code", "transfer_out_code"),
    *[T.StructField(n, T.DoubleType()) for n in (
        "expected_score", "expected_delta", "ownership_in", "ownership_out",
        "model_expected_in", "model_expected_out", "official_ep_next_in",
        "official_ep_next_out", "penalty", "xi_q10", "xi_q50", "xi_q90", "prob_beat_hold")],
    T.StructField("xi_quantiles", T.ArrayType(T.DoubleType())),
    *_longs("captain", "vice_captain")])
PLAN = T.StructType([
    *_longs("gw", "bank_tenths"), T.StructField("sell_bottom_q", T.DoubleType()),
    T.StructField("expected_source", T.StringType()),
    T.StructField("options", T.ArrayType(OPTION))])


def suggestions(plans: DataFrame) -> DataFrame:
    """Options of the newest plan, in plan order."""
    return (newest(plans).select("file", "gw", "bank_tenths", "expected_source",
                                 F.round(F.col("sell_bottom_q") * 100).cast("int")
                                 .alias("sell_bottom_pct"),
                                 F.posexplode("options").alias("place", "o"))
            .select("file", "gw", "bank_tenths", "sell_bottom_pct", "expected_source",
                    "place", "o.*").withColumnRenamed("expected_delta", "expected_gain"))
