"""The supplied tables in the roles of the data model, as DataFrames.

``events`` by (user, day) is the panel, ``customer`` the entities of the panel, orders
with their lines are matches and squads, ``part`` is the pool of squad members. The same
roles in SQL are in :mod:`panelspark.plans.roles_sql`.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark import schemas as S
from panelspark.functions import scalar as X
from panelspark.operators import panel as P
from panelspark.operators import scale
from panelspark.operators import squads as Q

XI = 4                      # starters of the squads made of order lines
CODE_BASE = 1_000_000       # stable code = customer key + CODE_BASE
SEGMENTS = {"AUTOMOBILE": "GKP", "BUILDING": "DEF", "FURNITURE": "MID", "HOUSEHOLD": "FWD"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def money(c: str | Column) -> Column:
    return X.col(c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    """Exact sum of amounts, as a double."""
    return F.sum(money(c)).cast("double")
NEXT_SQUAD = 1_000_000_000_000  # above any customer key



class Roles:
    """Lazy role tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf
        self._tables: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        """A supplied table; its footer is read once per query."""
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.sf, name)
        return self._tables[name]

    # -- entities and panel ------------------------------------------------------

    def panel(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        active = F.col("event_type").isin("click", "purchase")
        return self.t("events").groupBy(
            F.col("user_id").alias("player_id"),
            F.dayofmonth("ts").cast("bigint").alias("gw")).agg(
            total("value").alias("total_points"),
            F.sum(F.when(active, k).otherwise(0)).alias("minutes"),
            F.count_if(F.col("event_type") == "purchase").alias("starts"),
            F.max(money("value")).cast("double").alias("now_cost"))

    def players(self) -> DataFrame:
        return self.t("customer").select(
            (F.col("c_custkey") + CODE_BASE).alias("player_code"),
            F.col("c_custkey").alias("player_id"),
            F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("second_name"),
            F.col("c_name").alias("web_name"),
            F.col("c_nationkey").cast("bigint").alias("team_code"),
            X.lookup("c_mktsegment", SEGMENTS, F.lit("UNK")).alias("position"),
            (F.col("c_acctbal") / 100.0).alias("now_cost"))

    def team_history(self) -> DataFrame:
        return self.t("events").where(F.col("event_type") == "signup").groupBy(
            F.col("user_id").alias("player_id"),
            F.dayofmonth("ts").cast("bigint").alias("gw")).agg(
            F.pmod(F.min("event_id"), F.lit(25)).alias("team_code"))

    def teams(self) -> DataFrame:
        return self.t("nation").select(
            F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 5 == 0, F.lit(None))
            .otherwise(F.substring("n_name", 8, 10)).alias("short_name"))

    def matches(self) -> DataFrame:
        lines = self.t("lineitem").groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("s_suppkey"),
            F.count_if(F.col("l_returnflag") == "A").alias("na"),
            F.count_if(F.col("l_returnflag") == "R").alias("nr"))
        done = F.col("o_orderstatus") != "P"
        return (
            self.t("orders").join(self.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(self.t("supplier"), "s_suppkey")
            .select(
                F.year("o_orderdate").cast("string").alias("season"),
                F.col("o_orderkey").alias("match_id"),
                F.dayofmonth("o_orderdate").cast("bigint").alias("gw"),
                F.col("c_nationkey").cast("bigint").alias("home_team"),
                F.col("s_nationkey").cast("bigint").alias("away_team"),
                F.when(done, F.col("na")).alias("home_score"),
                F.when(done, F.col("nr")).alias("away_score"),
                F.when(done, F.col("c_acctbal")).alias("home_team_elo"),
                F.when(done, F.col("s_acctbal")).alias("away_team_elo"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "cup").otherwise("prem")
                .alias("tournament"),
                done.alias("finished")))

    def features(self) -> DataFrame:
        return P.build_features(self.panel(), self.team_history(), self.matches(),
                                self.players())

    def form(self) -> DataFrame:
        """Panel with entity columns and lagged features, first rows left out."""
        base = self.panel().join(
            self.players().select("player_id", "player_code", "position", "team_code",
                                  "web_name"), "player_id")
        return P.trailing_features(base).where(F.col("prev_points").isNotNull())

    def scored(self) -> DataFrame:
        """Forecast (mean of the last three rows) and outcome (next row)."""
        return self.form().where(F.col("next_points").isNotNull()).select(
            "player_id", "player_code", "gw", "position", "team_code",
            F.col("next_points").alias("actual"), F.round("pts_avg_3", 6).alias("pred"),
            F.round("pts_avg_5", 6).alias("pred_5"), "prev_points", "now_cost")

    def residuals(self) -> DataFrame:
        """Forecast errors with the club and its opponent of the period."""
        side = P.fixture_context(self.matches()).select("gw", "team_code",
                                                        "opponent_team_code")
        return (self.scored().join(side, ["gw", "team_code"])
                .withColumn("resid", F.col("actual") - F.col("pred")))

    # -- snapshot ----------------------------------------------------------------

    def live(self) -> DataFrame:
        last = scale.keep_one(self.t("orders"), ["o_custkey"], [
            F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
        k = F.col("o_orderkey")
        rows = last.join(self.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            (F.col("o_custkey") + CODE_BASE).alias("player_code"),
            F.col("o_custkey").alias("player_id"), F.col("c_name").alias("web_name"),
            F.when(k % 10 == 0, F.lit(None))
            .when(k % 7 == 0, (F.col("c_nationkey") + 1) % 25)
            .otherwise(F.col("c_nationkey")).cast("bigint").alias("team_code"),
            (k % 4 + 1).alias("element_type"),
            (X.to_tenths(F.col("c_acctbal") / 100.0)
             + F.when(k % 6 == 0, k % 5 - 2).otherwise(F.lit(0))).alias("now_cost"),
            X.lookup("o_orderstatus", {"F": "a", "O": "d"}, F.when(k % 3 == 0, "i")
                     .when(k % 3 == 1, "s").otherwise("u")).alias("status"),
            F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("  "))
            .otherwise(F.lit("knock")).alias("news"),
            X.lookup("o_orderpriority", {"1-URGENT": 0.0, "2-HIGH": 50.0, "3-MEDIUM": 75.0,
                                         "5-LOW": 100.0}).alias("chance_of_playing_next_round"),
            F.when(k % 9 == 0, F.lit("none")).otherwise(
                (k % 1000).cast("string")).alias("selected_by_percent"),
            F.when(k % 5 == 0, F.lit(None)).otherwise((k % 12).cast("string")).alias("ep_next"),
            F.when(k % 8 == 0, F.lit(None)).otherwise(k % 11 == 0).alias("removed"),
            F.when(k % 14 == 0, F.lit(None)).otherwise(k % 13 != 0).alias("can_select"))

    # -- squads --------------------------------------------------------------------

    def elements(self) -> DataFrame:
        size = F.col("p_size")
        price = F.col("p_retailprice") / 100.0
        return self.t("part").select(
            F.col("p_partkey").alias("player_code"), F.col("p_partkey").alias("player_id"),
            F.col("p_name").alias("web_name"),
            F.when(size <= 8, "GKP").when(size <= 22, "DEF").when(size <= 38, "MID")
            .otherwise("FWD").alias("position"),
            F.substring("p_brand", 7, 10).cast("bigint").alias("team_code"),
            price.alias("now_cost"), X.to_tenths(price).alias("price_tenths"))

    def element_values(self) -> DataFrame:
        """Mean quantity per line of a part: the expected points of a pool member."""
        return self.t("lineitem").groupBy(F.col("l_partkey").alias("player_code")).agg(
            F.round(total("l_quantity") / F.count(F.lit(1)), 4).alias("value"))

    def pool(self) -> DataFrame:
        return self.elements().join(self.element_values(), "player_code", "left").withColumn(
            "value", F.coalesce("value", F.lit(0.0)))

    def lines(self) -> DataFrame:
        lines = self.t("lineitem")
        return scale.dealt(lines, lines.count(), "l_orderkey").join(
            self.t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def picks(self) -> DataFrame:
        """Squads of 15 places of a (customer, year): parts by quantity.

        Parts beyond the first 15 make further squads, entries NEXT_SQUAD ids apart. A
        customer's year holds a few dozen parts, so the window is over few rows.
        """
        rows = self.lines().select(
            F.col("o_custkey").alias("entry_id"),
            F.year("o_orderdate").cast("bigint").alias("gw"),
            F.col("l_partkey").alias("element"), "l_quantity")
        # One dealing serves the sums and the order of a year.
        owned = scale.dealt(rows, self.t("lineitem").count(), "entry_id", "gw").groupBy(
            "entry_id", "gw", "element").agg(total("l_quantity").alias("quantity"))
        order = Window.partitionBy("entry_id", "gw").orderBy(F.col("quantity").desc(), "element")
        before = F.row_number().over(order) - 1
        placed = owned.withColumn("before", before).select(
            (F.col("entry_id") + F.floor(F.col("before") / S.SQUAD_SIZE) * NEXT_SQUAD)
            .alias("entry_id"), "gw", "element", "quantity",
            (F.col("before") % S.SQUAD_SIZE + 1).alias("position"))
        slot = F.col("position")
        return placed.select(
            "entry_id", "gw", "element", "position",
            F.when(slot == 1, 2).when(slot <= XI, 1).otherwise(0).alias("multiplier"),
            (slot == 1).alias("is_captain"), (slot == 2).alias("is_vice_captain"), "quantity")

    def actuals(self) -> DataFrame:
        """Result of a part in a year; without returned lines it did not play."""
        flag = F.col("l_returnflag")
        return self.lines().groupBy(
            F.col("l_partkey").alias("player_code"),
            F.year("o_orderdate").cast("bigint").alias("gw")).agg(
            F.count_if((flag == "R") & (F.col("l_linestatus") == "O")).alias("minutes"),
            F.coalesce(F.sum(F.when(flag == "A", money("l_quantity"))), F.lit(0))
            .cast("double").alias("total_points"))

    def per_gw(self) -> DataFrame:
        return self.lines().groupBy(
            F.col("l_partkey").alias("player_code"),
            F.year("o_orderdate").cast("bigint").alias("gw")).agg(
            F.round(total("l_quantity") / F.count(F.lit(1)), 3).alias("expected_points"))

    def squad_picks(self) -> DataFrame:
        """Picks in the columns of the settlement, with results."""
        named = (self.picks().withColumnRenamed("position", "slot")
                 .withColumnRenamed("element", "player_code")
                 .withColumnRenamed("is_vice_captain", "is_vice")
                 .join(self.elements().select("player_code", "position", "team_code",
                                              "price_tenths", "web_name"), "player_code"))
        return Q.with_actuals(named, self.actuals())

    def settled(self) -> DataFrame:
        return Q.settle(self.squad_picks(), xi_size=XI, min_def=1, min_fwd=0)

    def members(self, picks: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
        """Squads of the swap queries: the picks with price, club and value.

        A query that reads picks and pool besides passes the tables it has written.
        """
        squad = F.concat_ws("-", "entry_id", "gw")
        picks = self.picks() if picks is None else picks
        pool = self.pool() if pool is None else pool
        return (picks.select(squad.alias("squad"),
                             F.col("element").alias("player_code"),
                             F.col("position").cast("bigint").alias("slot"))
                .join(pool, "player_code"))

    def basket(self) -> DataFrame:
        """Team = customer, members = the parts it ordered."""
        rows, n = self.lines(), self.t("lineitem").count()
        owned = scale.dealt(rows.select(
            F.col("o_custkey").alias("team_id"), F.col("l_partkey").alias("player_code"),
            "l_quantity"), n, "team_id", "player_code").groupBy("team_id", "player_code").agg(
            total("l_quantity").alias("expected_total"))
        return scale.dealt(owned, n, "player_code").join(self.elements().select(
            "player_code", "position", "team_code", "price_tenths"), "player_code")

    def month_totals(self) -> DataFrame:
        """Total per (customer, month) over the customers that ordered."""
        return self.t("orders").groupBy(
            F.col("o_custkey").alias("team_id"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("gw")
        ).agg((total(F.floor("o_totalprice")) / 997.0).alias("gw_total"),
              F.count(F.lit(1)).alias("orders"))

    def squad_dist(self) -> DataFrame:
        return self.month_totals().select(
            "team_id", "gw", F.col("gw_total").alias("sample_mean"),
            ((F.col("orders") - 1) * 25.0).alias("sample_std"))

    def vectors(self) -> DataFrame:
        """Quantile vector per part of its line prices."""
        rows = self.t("lineitem").select(
            F.col("l_partkey").alias("player_code"),
            F.col("l_extendedprice").alias("x"))
        return scale.exact_quantiles(rows, ["player_code"], "x", S.QS, "vector")

    # -- league ----------------------------------------------------------------------

    def standings(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.t("customer").select(
            c.alias("entry_id"), F.col("c_name").alias("entry_name"),
            F.col("c_mktsegment").alias("player_name"),
            F.when(c % 3 == 0, F.lit(None)).otherwise(c % 100).alias("rank"),
            F.when(c % 7 == 0, F.lit(None)).otherwise((c * 13) % 500).alias("total"))

    def league_matches(self) -> DataFrame:
        top = self.t("customer").agg(F.max("c_custkey")).scalar()
        k = F.col("o_orderkey")
        return self.t("orders").select(
            F.year("o_orderdate").cast("bigint").alias("event"),
            k.alias("match_id"), F.col("o_custkey").alias("entry_1_entry"),
            F.when(k % 17 == 0, F.lit(None)).otherwise(top - F.col("o_custkey"))
            .alias("entry_2_entry"),
            F.when(k % 23 == 0, F.lit(None)).otherwise(k % 90).alias("entry_1_points"),
            F.when(k % 29 == 0, F.lit(None)).otherwise((k * 7) % 90).alias("entry_2_points"),
            F.when(k % 31 == 0, F.lit(None)).otherwise(k % 19 == 0).alias("is_bye"))

    def history(self) -> DataFrame:
        return self.t("orders").groupBy(
            F.col("o_custkey").alias("entry_id"),
            F.year("o_orderdate").cast("bigint").alias("event")).agg(
            F.count(F.lit(1)).alias("points"), F.max("o_orderkey").alias("total_points"),
            F.min("o_orderkey").alias("rank"),
            F.count_if(F.col("o_orderstatus") == "F").alias("points_on_bench"),
            F.count_if(F.col("o_orderstatus") == "P").alias("event_transfers"))
