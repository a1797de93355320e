"""Parsers and writers, fed with files and payloads made from the match rows, some of them broken on purpose."""

import uuid

from pyspark.sql import functions as F

from pastward.plans.registry import query
from pastward.session import ensure_checkpoint_dir
from pastward.sources import payloads, period_files, results, sinks


def _text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("A2 A3 A13", """
WITH t AS (SELECT *, CASE WHEN match_id % 50 = 1 THEN 'someday' WHEN match_id % 50 = 2 THEN '' END AS bad_date,
  CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS outcome_ FROM matches WHERE match_id % 11 <> 0),
v AS (SELECT CASE WHEN bad_date IS NULL THEN match_date END AS match_date, CASE WHEN bad_date IS NULL AND match_id % 13 <> 0 THEN CAST(match_date AS TIMESTAMP) + INTERVAL 15 HOUR + INTERVAL 5 MINUTE END AS kickoff_time,
 CASE WHEN match_id % 40 = 3 THEN '' ELSE 'T' || home_team END AS home_team, 'T' || away_team AS away_team, home_goals, away_goals, outcome_ AS result,
 concat_ws('; ', CASE WHEN bad_date IS NOT NULL THEN 'unparseable date' END, CASE WHEN match_id % 40 = 3 THEN 'missing team name' END,
  CASE WHEN match_id % 60 = 5 THEN 'invalid result' END, CASE WHEN match_id % 60 = 7 AND outcome_ <> 'D' THEN 'result does not match goals' END,
  CASE WHEN bad_date IS NOT NULL AND match_id % 13 <> 0 THEN 'unparseable time' END) AS error FROM t)
SELECT match_date, kickoff_time, home_team, away_team, home_goals, away_goals, result, nullif(error, '') AS validation_error FROM v""")
def results_feed(tables):
    key, scored = F.col("match_id"), F.col("match_id") % 11 != 0
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").otherwise("A")
    source = tables.matches.select(
        F.when(key % 50 == 1, "someday").when(key % 50 == 2, "").otherwise(F.date_format("match_date", "d/M/yyyy")).alias("Date"),
        F.when(key % 13 == 0, " ").otherwise("15:05").alias("Time"), F.when(key % 40 == 3, "").otherwise(F.concat(F.lit(" T"), _text("home_team"))).alias("HomeTeam"),
        F.concat(F.lit("T"), _text("away_team")).alias("AwayTeam"), F.when(scored, _text("home_goals")).otherwise("").alias("FTHG"), _text("away_goals").alias("FTAG"),
        F.when(key % 60 == 5, "X").when(key % 60 == 7, "d").otherwise(F.lower(outcome)).alias("FTR"),
    )
    return results.parse_results(source, "s").drop("season")


@query("A6", """
WITH t AS (SELECT * FROM matches WHERE match_id % 5 <> 0), v AS (
SELECT CAST(match_id AS VARCHAR) AS feed_match_id, match_date, CASE WHEN match_id % 30 <> 1 THEN 'T' || home_team END AS home_team, 'T' || away_team AS away_team,
 CASE WHEN match_id % 30 <> 2 THEN home_xg END AS home_xg, away_xg, home_goals, CASE WHEN match_id % 30 <> 3 THEN away_goals END AS away_goals FROM t)
SELECT *, nullif(concat_ws('; ', CASE WHEN home_team IS NULL THEN 'missing home_team' END, CASE WHEN home_xg IS NULL THEN 'missing home_xg' END,
 CASE WHEN away_goals IS NULL THEN 'missing away_goals' END), '') AS validation_error FROM v""")
def match_payloads(tables):
    key = F.col("match_id")
    side = lambda s: F.struct(F.when((key % 30 != 1) | F.lit(s == "away"), F.concat(F.lit(" T"), _text(f"{s}_team"))).otherwise("").alias("title"))
    match = F.struct(
        key.alias("id"), F.when(key % 5 == 0, "no").otherwise("true").alias("isResult"), F.date_format("match_date", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        side("home").alias("h"), side("away").alias("a"), F.struct(F.when(key % 30 == 2, "n/a").otherwise(_text("home_xg")).alias("h"), F.col("away_xg").alias("a")).alias("xG"),
        F.struct(F.col("home_goals").alias("h"), F.when(key % 30 == 3, F.col("away_goals") + 0.5).otherwise(F.col("away_goals")).alias("a")).alias("goals"))
    rows = tables.matches.select(F.to_json(F.array(match)).alias("payload"))
    return payloads.parse_match_json(rows, "payload", "s").drop("season")


@query("A7", """
SELECT home_team AS team_id, 'T' || home_team AS team_name, match_date, 'h' AS venue, home_xg AS xg, away_xg AS xga, CASE WHEN away_goals > 0 THEN (home_goals + 1) / away_goals END AS ppda,
 CASE WHEN match_id % 9 <> 0 THEN CAST(away_goals AS DOUBLE) END AS ppda_allowed, home_goals AS scored, away_goals AS missed FROM matches""")
def team_history_payloads(tables):
    row = F.struct(
        F.lit("h").alias("h_a"), F.col("home_xg").alias("xG"), _text("away_xg").alias("xGA"), F.struct((F.col("home_goals") + 1).alias("att"), F.col("away_goals").alias("def")).alias("ppda"),
        F.when(F.col("match_id") % 9 == 0, "?").otherwise(_text("away_goals")).alias("ppda_allowed"), F.col("home_goals").alias("scored"), _text("away_goals").alias("missed"),
        F.date_format("match_date", "yyyy-MM-dd HH:mm:ss").alias("date"))
    team = F.struct(F.when(F.col("match_id") % 2 == 0, _text("home_team")).alias("id"), F.concat(F.lit(" T"), _text("home_team")).alias("title"), F.array(row).alias("history"))
    listed = F.to_json(F.struct(F.array(team).alias("teams")))
    by_id = F.to_json(F.struct(F.create_map(_text("home_team"), team).alias("teams")))
    rows = tables.matches.select(F.when(F.col("match_id") % 2 == 0, listed).otherwise(by_id).alias("payload"))
    return payloads.parse_team_history(rows, "payload", 2024).select("team_id", "team_name", "match_date", "venue", "xg", "xga", "ppda", "ppda_allowed", "scored", "missed")


@query("A8", """
SELECT CAST(match_id AS INT) AS player_id, CASE WHEN match_id % 3 = 0 THEN 2 ELSE 1 END AS event_id, CASE WHEN match_id % 5 = 0 THEN 'W' || match_id ELSE 'F' || match_id || ' L' END AS player_name,
 CASE WHEN match_id % 4 <> 0 THEN 'T' || home_team END AS team_name, home_goals AS now_cost, home_xg AS form, CASE WHEN match_id % 2 = 0 THEN 'a' ELSE 'd' END AS status FROM matches""")
def player_snapshot_payloads(tables):
    key = F.col("match_id")
    named = key % 5 != 0
    player = F.struct(
        key.alias("id"), F.when(named, F.concat(F.lit("F"), _text("match_id"))).otherwise(" ").alias("first_name"), F.when(named, "L").otherwise("").alias("second_name"),
        F.concat(F.lit("W"), _text("match_id")).alias("web_name"), F.col("home_team").alias("team"), F.col("home_goals").alias("now_cost"), _text("home_xg").alias("form"),
        F.when(key % 2 == 0, "a").otherwise("d").alias("status"))
    events = F.array(
        F.struct(F.lit(1).alias("id"), F.lit(False).alias("is_next"), (key % 2 == 0).alias("is_current")), F.struct(F.lit(2).alias("id"), (key % 3 == 0).alias("is_next"), F.lit(False).alias("is_current")))
    team = F.when(key % 4 == 0, -1).otherwise(F.col("home_team"))
    teams = F.array(F.struct(team.alias("id"), F.concat(F.lit("T"), _text("home_team")).alias("name")))
    rows = tables.matches.select(F.to_json(F.struct(events.alias("events"), teams.alias("teams"), F.array(player).alias("elements"))).alias("payload"))
    return payloads.parse_player_snapshot(rows, "payload").select("player_id", "event_id", "player_name", "team_name", "now_cost", "form", "status")


@query("A9", """
SELECT CAST(match_id AS INT) AS fixture_id, CASE WHEN match_id % 3 <> 0 THEN CAST(season AS INT) END AS event_id, kickoff_time, home_team AS team_h_id, away_team AS team_a_id, 'T' || home_team AS team_h_name,
 CASE WHEN match_id % 4 = 0 THEN 'S' || away_team ELSE 'T' || away_team END AS team_a_name, CASE WHEN match_id % 6 <> 0 THEN home_goals END AS team_h_score, match_id % 6 <> 0 AS finished FROM matches""")
def fixture_payloads(tables):
    key = F.col("match_id")
    teams = F.array(
        F.struct(F.col("home_team").alias("id"), F.concat(F.lit("T"), _text("home_team")).alias("name"), F.lit("x").alias("short_name")),
        F.struct(F.col("away_team").alias("id"), F.when(key % 4 != 0, F.concat(F.lit("T"), _text("away_team"))).alias("name"), F.concat(F.lit("S"), _text("away_team")).alias("short_name")))
    fixture = F.struct(
        key.alias("id"), F.when(key % 3 != 0, F.col("season")).alias("event"), F.when(F.col("kickoff_time").isNull(), "later").otherwise(F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("kickoff_time"),
        F.col("home_team").alias("team_h"), _text("away_team").alias("team_a"), F.when(key % 6 != 0, F.col("home_goals")).alias("team_h_score"), (key % 6 != 0).alias("finished"))
    rows = tables.matches.select(F.to_json(F.struct(teams.alias("teams"))).alias("bootstrap"), F.to_json(F.array(fixture)).alias("fixtures"))
    out = payloads.parse_fixture_snapshot(rows, "fixtures", "bootstrap")
    return out.select("fixture_id", "event_id", "kickoff_time", "team_h_id", "team_a_id", "team_h_name", "team_a_name", "team_h_score", "finished")


@query("A10", """
WITH k AS (SELECT DISTINCT home_team AS player_id FROM matches WHERE home_team % 3 <> 0)
SELECT m.home_team AS player_id, coalesce('P' || k.player_id, CAST(m.home_team AS VARCHAR)) AS player_name, home_goals AS goals_scored, 0 AS minutes, CASE WHEN match_id % 7 <> 0 THEN home_xg END AS expected_goals,
 CASE WHEN k.player_id IS NULL THEN 'unmatched' ELSE 'matched' END AS identity_status FROM matches m LEFT JOIN k ON k.player_id = m.home_team""")
def live_payloads(tables):
    stats = F.struct(_text("home_goals").alias("goals_scored"), F.when(F.col("match_id") % 7 == 0, "-").otherwise(_text("home_xg")).alias("expected_goals"))
    rows = tables.matches.select(F.to_json(F.struct(F.array(F.struct(F.col("home_team").alias("id"), stats.alias("stats"))).alias("elements"))).alias("payload"))
    known = tables.matches.filter(F.col("home_team") % 3 != 0).select(F.col("home_team").alias("player_id")).distinct().select(
        "player_id", F.lit(1).alias("code"), F.concat(F.lit("P"), _text("player_id")).alias("player_name"), F.lit(1).alias("team_id"), F.lit(1).alias("position_id"))
    out = payloads.parse_live_period(rows, "payload", known, "s", 4)
    return out.select("player_id", "player_name", "goals_scored", "minutes", "expected_goals", "identity_status")


@query("A11", """
SELECT home_team AS player, CAST(match_id % 38 + 1 AS INT) AS gameweek, kickoff_time, match_id % 2 = 0 AS was_home, home_goals AS goals_scored, CAST(NULL AS INT) AS assists, home_xg AS expected_goals FROM matches""")
def player_history_payloads(tables):
    row = F.struct(
        (F.col("match_id") % 38 + 1).alias("round"), F.coalesce(F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("kickoff_time"),
        (F.col("match_id") % 2 == 0).alias("was_home"), F.col("home_goals").alias("goals_scored"), _text("home_xg").alias("expected_goals"))
    rows = tables.matches.select(F.col("home_team").alias("player"), F.to_json(F.struct(F.array(row).alias("history"))).alias("payload"))
    out = payloads.parse_player_history(rows, "player", "payload")
    return out.select("player", "gameweek", "kickoff_time", "was_home", "goals_scored", "assists", "expected_goals")


@query("A12", """
SELECT CAST(match_id AS INT) AS id, home_team AS team, home_goals AS position, home_xg / 10 AS now_cost, CASE WHEN match_id % 3 = 0 THEN 'a' WHEN match_id % 3 = 1 THEN 'd' END AS status, match_id % 3 = 0 AS is_available FROM matches""")
def player_master(tables):
    status = F.when(F.col("match_id") % 3 == 0, "a").when(F.col("match_id") % 3 == 1, "d")
    rows = tables.matches.select(_text("match_id").alias("id"), F.col("home_team").alias("team"), _text("home_goals").alias("element_type"), _text("home_xg").alias("now_cost"), status.alias("status"))
    return payloads.clean_players(rows).select("id", "team", "position", "now_cost", "status", "is_available")


def _path(tables):
    return f"{ensure_checkpoint_dir(tables.spark).rstrip('/')}/sinks/{uuid.uuid4().hex}"


@query("B1 B2", """
SELECT match_id, CAST(season AS INT) AS season, home_goals FROM matches WHERE season NOT IN (1993, 1994) UNION ALL SELECT match_id, CAST(season AS INT), home_goals + 10 FROM matches WHERE season = 1993""")
def refreshed_and_replaced_slices(tables):
    path, rows = _path(tables), tables.matches.select("match_id", "season", "home_goals")
    sinks.overwrite(rows.limit(10), path, ["season"])
    sinks.overwrite(rows, path, ["season"])
    sinks.replace_slice(rows.filter("season = 1993").withColumn("home_goals", F.col("home_goals") + 10), path, {"season": 1993})
    sinks.replace_slice(rows.filter("season = 1994 AND match_id < 0"), path, {"season": 1994})
    return tables.spark.read.parquet(path).select("match_id", F.col("season").cast("int").alias("season"), "home_goals")


@query("B6", """
SELECT match_id, CAST(1 AS INT) AS run_id FROM matches WHERE league = 1 UNION ALL SELECT match_id, 2 FROM matches WHERE league = 2""")
def repeated_runs(tables):
    path, rows = _path(tables), tables.matches.select("match_id", "league")
    for run, league in ((1, 0), (2, 2), (1, 1), (2, 2)):
        sinks.append_run(rows.filter(F.col("league") == league).select("match_id"), path, run)
    return tables.spark.read.parquet(path).select("match_id", F.col("run_id").cast("int").alias("run_id"))


_SEASON = "season || '-' || lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0')"


@query("A4 A5", f"""
SELECT {_SEASON} AS season, gameweek, CASE WHEN trim(player_source_id) <> '' THEN player_source_id END AS player_source_id,
 CASE WHEN CAST(season AS INT) % 2 = 0 THEN player_name || ', "Jr"' ELSE 'P ' || player_name END AS player_name, CASE WHEN trim(team_name) <> '' THEN team_name END AS team_name, minutes, total_points,
 {_SEASON} || '/gws/' || row_id % 50 || '/gw' || gameweek || '.csv' AS source_file FROM history""")
def period_file_rows(tables):
    """Files of two layouts, with quoted commas and unreadable numbers, written as text from the history rows and read back."""
    even = F.col("season").cast("int") % 2 == 0
    empty = lambda c: F.coalesce(_text(c), F.lit(""))
    quoted = F.concat(F.lit('"'), F.col("player_name"), F.lit(', ""Jr"""'))
    first = F.concat_ws(",", F.lit(""), empty("player_source_id"), quoted, empty("team_name"), empty("minutes"), F.coalesce(_text("total_points"), F.lit("n/a")), F.lit("x"))
    second = F.concat_ws(",", empty("total_points"), F.lit("P"), "player_name", empty("team_name"), F.coalesce(_text("minutes"), F.lit("-")), empty("player_source_id"))
    header = F.when(even, ",Element,Name,Team,Minutes,Total Points,Unknown").otherwise("total_points,first_name,second_name,team_name,minutes,id")
    season = F.concat("season", F.lit("-"), F.lpad(((F.col("season").cast("int") + 1) % 100).cast("string"), 2, "0"))
    path = F.concat(F.lit("/"), season, F.lit("/gws/"), _text(F.col("row_id") % 50), F.lit("/gw"), _text("gameweek"), F.lit(".csv"))
    lines = tables.history.select(path.alias("path"), header.alias("header"), F.when(even, first).otherwise(second).alias("line"))
    # A file is one of fifty parts of a season and period.
    files = lines.groupBy("path", "header").agg(F.array_join(F.collect_list("line"), "\r\n").alias("lines")).select("path", F.concat("header", F.lit("\r\n"), "lines").alias("value"))
    return period_files.parsed_files(files).select("season", "gameweek", "player_source_id", "player_name", "team_name", "minutes", "total_points", "source_file")


@query("A14", """
WITH t AS (SELECT CASE WHEN match_id % 17 = 0 THEN '' ELSE 'T' || home_team END AS team_name, CASE WHEN match_id % 19 = 0 OR match_id % 31 = 0 THEN '' ELSE 'M' || match_id % 7 END AS manager_name,
 CASE WHEN match_id % 31 <> 0 AND match_id % 23 <> 0 THEN match_date END AS start_date, match_id % 23 = 0 AS bad,
 CASE WHEN match_id % 31 <> 0 AND match_id % 3 <> 0 THEN match_date + CASE WHEN match_id % 29 = 0 THEN -10 ELSE CAST(match_id % 300 AS INT) END END AS end_date,
 CASE WHEN match_id % 31 <> 0 THEN 'n' || match_id ELSE '' END AS source_note FROM matches WHERE match_id % 31 <> 0),
v AS (SELECT *, concat_ws('; ', CASE WHEN team_name = '' THEN 'missing team' END, CASE WHEN manager_name = '' THEN 'missing manager' END, CASE WHEN bad THEN 'bad start date' END,
 CASE WHEN start_date > end_date THEN 'ends before it starts' END) AS validation_error FROM t)
SELECT team_name, manager_name, CASE WHEN bad THEN 'soon' ELSE CAST(start_date AS VARCHAR) END AS start_date, coalesce(CAST(end_date AS VARCHAR), CASE WHEN validation_error <> '' THEN '' END) AS end_date,
 source_note, nullif(validation_error, '') AS validation_error FROM v""")
def tenure_rows(tables):
    key, filled = F.col("match_id"), F.col("match_id") % 31 != 0
    end = F.date_add("match_date", F.when(key % 29 == 0, -10).otherwise(key % 300).cast("int"))
    raw = tables.matches.select(
        F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit(" T"), _text("home_team"))).alias("team_name"), F.when(filled & (key % 19 != 0), F.concat(F.lit("M"), _text(key % 7))).alias("manager_name"),
        F.when(filled, F.when(key % 23 == 0, "soon").otherwise(_text("match_date"))).alias("start_date"), F.when(filled & (key % 3 != 0), _text(end)).alias("end_date"),
        F.when(filled, F.concat(F.lit("n"), _text(key))).alias("source_note"))
    good, bad = results.parse_tenures(raw)
    return good.withColumns({"start_date": _text("start_date"), "end_date": _text("end_date"), "validation_error": F.lit(None).cast("string")}).unionByName(bad)


@query("L19", """
SELECT 'rows' AS check_name, count(*) AS bad_rows FROM matches UNION ALL SELECT 'missing_kickoff_time', count(*) FILTER (kickoff_time IS NULL) FROM matches
UNION ALL SELECT 'missing_team', count(*) FILTER (match_id % 43 = 0) FROM matches UNION ALL SELECT 'unmapped_team', count(*) FILTER (match_id % 43 = 0 OR match_id % 47 = 0) FROM matches""")
def snapshot_findings(tables):
    team = F.when(F.col("match_id") % 43 != 0, F.when(F.col("match_id") % 47 == 0, "  ").otherwise(F.concat(F.lit("T"), _text("home_team"))))
    return results.validate_snapshot(tables.matches.select("match_id", "kickoff_time", team.alias("team")), ["kickoff_time", "team"], ["team"])
