"""Domain views over the given tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastward.functions.scalars import event_time, outcome
from pastward.operators.reshape import team_rows


class Tables:
    """Lazy access to the tables of one folder and to the views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Event times are dates at midnight or noon UTC, whatever the machine's zone is.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @functools.cached_property
    def matches(self) -> DataFrame:
        key, price = F.col("o_orderkey"), F.col("o_totalprice")
        whole = F.floor(price).cast("bigint")
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("match_id"),
                F.col("n_regionkey").alias("league"),
                F.year("o_orderdate").alias("season"),
                F.to_date("o_orderdate").alias("match_date"),
                F.when(key % 10 != 0, F.col("o_orderdate") + F.expr("INTERVAL '12' HOUR")).alias("kickoff_time"),
                (F.col("o_custkey") % 20).cast("int").alias("home_team"),
                ((F.col("o_custkey") % 20 + 1 + key % 19) % 20).cast("int").alias("away_team"),
                (whole % 5).cast("int").alias("home_goals"),
                (F.floor(price / 7).cast("bigint") % 4).cast("int").alias("away_goals"),
                ((whole % 300).cast("double") / 100).alias("home_xg"),
                ((F.floor(price / 3).cast("bigint") % 250).cast("double") / 100).alias("away_xg"),
            )
            .withColumn("event_time", event_time("kickoff_time", "match_date"))
        )

    @functools.cached_property
    def team_rows(self) -> DataFrame:
        return team_rows(
            self.matches,
            keep=["match_id", "league", "season", "match_date", "event_time"],
            sides={
                "team": ("home_team", "away_team"),
                "opponent": ("away_team", "home_team"),
                "goals_for": ("home_goals", "away_goals"),
                "goals_against": ("away_goals", "home_goals"),
                "xg_for": ("home_xg", "away_xg"),
                "xg_against": ("away_xg", "home_xg"),
            },
        )

    @functools.cached_property
    def player_rows(self) -> DataFrame:
        event = F.col("event_id")
        return self.read("events").select(
            event.alias("row_id"),
            F.lit(2024).alias("season"),
            F.dayofmonth("ts").alias("gameweek"),
            F.col("user_id").alias("player_id"),
            F.col("ts").alias("kickoff_time"),
            ((event % 7).cast("int") - 1).alias("total_points"),
            F.when(F.col("event_type") != "error", (event % 91).cast("int")).alias("minutes"),
            (event % 3).cast("int").alias("goals"),
            ((F.col("user_id") % 4).cast("int") + 1).alias("position"),
            (F.col("user_id") % 20).cast("int").alias("team_id"),
            F.when(F.col("event_type") != "signup", F.round("value", 2)).alias("xg"),
        )

    @functools.cached_property
    def preds(self) -> DataFrame:
        key = F.col("match_id")
        home, draw, away = key * 7 % 10 + 1, key * 3 % 7 + 1, key * 11 % 9 + 1
        total = home + draw + away
        return self.matches.select(
            "match_id", "league", "season", "match_date", "event_time", "home_team", "away_team",
            "home_goals", "away_goals",
            outcome("home_goals", "away_goals").alias("actual"),
            (home.cast("double") / total).alias("p_home"),
            (draw.cast("double") / total).alias("p_draw"),
            (away.cast("double") / total).alias("p_away"),
        )

    @functools.cached_property
    def candidates(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.read("part").select(
            key.alias("player_id"),
            (key % 20).cast("int").alias("team_id"),
            ((key % 4).cast("int") + 1).alias("position"),
            (F.col("p_size") + 39).cast("int").alias("now_cost"),
            (F.floor("p_retailprice").cast("double") / 200).alias("expected_points"),
        )

    @functools.cached_property
    def tenures(self) -> DataFrame:
        spans = (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("team_id"), F.col("l_linenumber").cast("int").alias("manager_id"))
            .agg(F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max("l_shipdate")).alias("end_date"))
        )
        return spans.withColumn("end_date", F.when(F.col("manager_id") != 4, F.col("end_date")))

    @functools.cached_property
    def snapshots(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("snapshot_id"),
            F.year("o_orderdate").alias("run_id"),
            F.col("o_custkey").alias("player_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("now_cost"),
            F.to_date("o_orderdate").alias("snapshot_date"),
        )


    @functools.cached_property
    def history(self) -> DataFrame:
        """Event rows of named players, with gaps and drifting spellings."""
        key, cust = F.col("o_orderkey"), F.col("c_custkey")
        source = cust.cast("string")
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == cust)
            .select(
                key.alias("row_id"),
                F.year("o_orderdate").cast("string").alias("season"),
                F.month("o_orderdate").alias("gameweek"),
                F.when(key % 97 == 0, F.lit(None)).when(key % 89 == 0, F.lit(" ")).otherwise(source).alias("player_source_id"),
                F.when(key % 5 == 0, F.concat(F.upper("c_name"), F.lit(" 7"))).when(key % 31 == 0, F.lit("Jos\u00e9 \u00d1u\u00f1ez")).otherwise(F.col("c_name")).alias("player_name"),
                F.when(key % 41 == 0, F.lit(None)).when(key % 43 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("team_name"),
                F.when(key % 37 == 0, F.lit(None)).otherwise(F.substring("o_orderpriority", 1, 1)).alias("position"),
                F.when(key % 11 != 0, (key % 400).cast("int")).alias("fixture_id"),
                F.when(key % 13 != 0, (key % 91).cast("int")).alias("minutes"),
                F.when(key % 1999 != 0, (key % 17).cast("int") - 2).alias("total_points"),
                F.when(key % 3 != 0, (F.floor("o_totalprice").cast("bigint") % 100).cast("double") / 100).alias("expected_goals"),
                (F.floor("o_totalprice").cast("bigint") % 60).cast("int").alias("value"),
                F.concat(F.lit("f"), F.month("o_orderdate").cast("string")).alias("source_file"),
            )
        )

    @functools.cached_property
    def master(self) -> DataFrame:
        """One row per player and season; one season has none, players in debt are missing."""
        cust = F.col("c_custkey")
        years = F.explode(F.sequence(F.lit(1992), F.lit(2001))).alias("year")
        return (
            self.read("customer").filter(F.col("c_acctbal") >= 0).select(cust, "c_name", years)
            .filter(F.col("year") != 1995)
            .select(
                F.col("year").cast("string").alias("season"),
                cust.cast("string").alias("element_id"),
                (cust - (cust % 25 == 0).cast("int")).alias("code"),
                F.when(cust % 6 == 0, F.concat(F.lit("X "), F.col("c_name"))).otherwise(F.col("c_name")).alias("name_raw"),
                (cust % 5 + 1).cast("string").alias("position_raw"),
            )
        )

    @functools.cached_property
    def division(self) -> DataFrame:
        """Matches of a division from which the three teams with the fewest goals drop out for a season."""
        goals = self.team_rows.groupBy("league", "season", "team").agg(F.sum("goals_for").alias("goals"))
        worst = Window.partitionBy("league", "season").orderBy("goals", "team")
        out = goals.withColumn("r", F.row_number().over(worst)).filter("r <= 3").select("league", (F.col("season") + 1).alias("season"), "team")
        matches = self.matches
        for side in ("home_team", "away_team"):
            matches = matches.join(out.withColumnRenamed("team", side), ["league", "season", side], "left_anti")
        return matches


# The same views for the SQL engine that checks the results.
SQL = {
    "matches": """
SELECT o_orderkey AS match_id, n_regionkey AS league, CAST(year(o_orderdate) AS INT) AS season,
 CAST(o_orderdate AS DATE) AS match_date,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate + INTERVAL '12' HOUR END AS kickoff_time,
 CAST(o_custkey % 20 AS INT) AS home_team,
 CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS INT) AS away_team,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) AS home_goals,
 CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS INT) AS away_goals,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 300 AS DOUBLE) / 100 AS home_xg,
 CAST(CAST(floor(o_totalprice / 3) AS BIGINT) % 250 AS DOUBLE) / 100 AS away_xg,
 CASE WHEN o_orderkey % 10 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
  ELSE CAST(o_orderdate + INTERVAL '12' HOUR AS TIMESTAMP) END AS event_time
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "team_rows": """
SELECT match_id, league, season, match_date, event_time, 'H' AS venue, home_team AS team, away_team AS opponent,
 home_goals AS goals_for, away_goals AS goals_against, home_xg AS xg_for, away_xg AS xg_against FROM matches
UNION ALL
SELECT match_id, league, season, match_date, event_time, 'A', away_team, home_team,
 away_goals, home_goals, away_xg, home_xg FROM matches""",
    "player_rows": """
SELECT event_id AS row_id, 2024 AS season, CAST(day(ts) AS INT) AS gameweek, user_id AS player_id,
 ts AS kickoff_time, CAST(event_id % 7 AS INT) - 1 AS total_points,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 91 AS INT) END AS minutes,
 CAST(event_id % 3 AS INT) AS goals, CAST(user_id % 4 AS INT) + 1 AS position,
 CAST(user_id % 20 AS INT) AS team_id,
 CASE WHEN event_type = 'signup' THEN NULL ELSE round(value, 2) END AS xg
FROM events""",
    "preds": """
SELECT match_id, league, season, match_date, event_time, home_team, away_team, home_goals, away_goals,
 CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS actual,
 CAST(match_id*7%10+1 AS DOUBLE) / (match_id*7%10+1 + match_id*3%7+1 + match_id*11%9+1) AS p_home,
 CAST(match_id*3%7+1 AS DOUBLE) / (match_id*7%10+1 + match_id*3%7+1 + match_id*11%9+1) AS p_draw,
 CAST(match_id*11%9+1 AS DOUBLE) / (match_id*7%10+1 + match_id*3%7+1 + match_id*11%9+1) AS p_away
FROM matches""",
    "candidates": """
SELECT p_partkey AS player_id, CAST(p_partkey % 20 AS INT) AS team_id, CAST(p_partkey % 4 AS INT) + 1 AS position,
 CAST(p_size + 39 AS INT) AS now_cost, CAST(floor(p_retailprice) AS DOUBLE) / 200 AS expected_points
FROM part""",
    "tenures": """
SELECT l_suppkey AS team_id, CAST(l_linenumber AS INT) AS manager_id, CAST(min(l_shipdate) AS DATE) AS start_date,
 CASE WHEN CAST(l_linenumber AS INT) = 4 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) END AS end_date
FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "snapshots": """
SELECT o_orderkey AS snapshot_id, CAST(year(o_orderdate) AS INT) AS run_id, o_custkey AS player_id,
 o_orderstatus AS status, o_totalprice AS now_cost, CAST(o_orderdate AS DATE) AS snapshot_date
FROM orders""",
    "history": """
SELECT o_orderkey AS row_id, CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(month(o_orderdate) AS INT) AS gameweek,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN ' ' ELSE CAST(c_custkey AS VARCHAR) END AS player_source_id,
 CASE WHEN o_orderkey % 5 = 0 THEN upper(c_name) || ' 7' WHEN o_orderkey % 31 = 0 THEN 'Jos\u00e9 \u00d1u\u00f1ez' ELSE c_name END AS player_name,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '  ' ELSE c_mktsegment END AS team_name,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS position,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 400 AS INT) END AS fixture_id,
 CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 91 AS INT) END AS minutes,
 CASE WHEN o_orderkey % 1999 <> 0 THEN CAST(o_orderkey % 17 AS INT) - 2 END AS total_points,
 CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) / 100 END AS expected_goals,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS INT) AS value, 'f' || CAST(month(o_orderdate) AS VARCHAR) AS source_file
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "master": """
SELECT CAST(y AS VARCHAR) AS season, CAST(c_custkey AS VARCHAR) AS element_id, c_custkey - CAST(c_custkey % 25 = 0 AS INT) AS code,
 CASE WHEN c_custkey % 6 = 0 THEN 'X ' || c_name ELSE c_name END AS name_raw, CAST(c_custkey % 5 + 1 AS VARCHAR) AS position_raw
FROM customer, range(1992, 2002) r(y) WHERE c_acctbal >= 0 AND y <> 1995""",
    "relegated": """
SELECT league, season + 1 AS season, team FROM (SELECT league, season, team, row_number() OVER (PARTITION BY league, season
 ORDER BY sum(goals_for), team) AS r FROM team_rows GROUP BY league, season, team) WHERE r <= 3""",
    "division": """
SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM relegated x WHERE x.league = m.league AND x.season = m.season
 AND x.team IN (m.home_team, m.away_team))""",
    # Strictly earlier rows of the same team, numbered from the latest back.
    "team_past": """
SELECT a.match_id, a.league, a.team, a.venue, p.venue AS past_venue, p.goals_for, p.goals_against, p.xg_for,
 p.xg_against, p.match_id AS past_id, p.event_time AS past_time,
 CASE WHEN p.goals_for > p.goals_against THEN 3 WHEN p.goals_for = p.goals_against THEN 1 ELSE 0 END AS points,
 row_number() OVER (PARTITION BY a.match_id, a.team ORDER BY p.event_time DESC, p.match_id DESC) AS back,
 row_number() OVER (PARTITION BY a.match_id, a.team, p.venue ORDER BY p.event_time DESC, p.match_id DESC) AS venue_back
FROM team_rows a JOIN team_rows p ON p.league = a.league AND p.team = a.team AND p.event_time < a.event_time""",
}
