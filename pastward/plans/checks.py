"""Data quality, audits and identity."""

from pyspark.sql import functions as F

from pastward.functions.scalars import points_for
from pastward.operators import history, identity, joins, match_features, pairs, quality, ratings, standings
from pastward.operators.decisions import prediction_rows
from pastward.operators.ranks import positions, running_totals
from pastward.operators.reshape import struct_rows
from pastward.plans.common import LEAGUE, SEASON, rounded
from pastward.plans.history import BASE_SQL, H2H_SQL
from pastward.plans.players import _COLLAPSED, _KW, _PRIOR_COLS, _PRIOR_WINDOWS, _PPF_SQL, collapsed
from pastward.plans.players import _period_features
from pastward.plans.registry import query
from pastward.plans.relational import coverage_by_season
from pastward.plans.standings import TABLE_SQL, _PRESSURE_CTE, elo_cte
from pastward.sources.tables import materialize

# ---- integrity -----------------------------------------------------------------------


@query("L1", """
SELECT 'rows' AS check_name, count(*) AS bad_rows FROM matches UNION ALL SELECT 'null_match_date', count(*) FILTER (match_date IS NULL) FROM matches
UNION ALL SELECT 'null_kickoff_time', count(*) FILTER (kickoff_time IS NULL) FROM matches UNION ALL SELECT 'null_goals', count(*) FILTER (home_goals IS NULL OR away_goals IS NULL) FROM matches
UNION ALL SELECT 'same_team', count(*) FILTER (home_team = away_team) FROM matches UNION ALL SELECT 'result_against_goals', count(*) FILTER ((home_goals > away_goals) <> (home_xg > away_xg)) FROM matches
UNION ALL SELECT 'duplicate_fixture_groups', count(*) FROM (SELECT 1 FROM matches GROUP BY league, season, home_team, away_team HAVING count(*) > 1)""")
def integrity_suite(tables):
    rows = tables.matches
    stated = F.when(F.col("home_xg") > F.col("away_xg"), "H").otherwise("not H")
    counts = {
        "rows": F.count("*"), "null_match_date": F.count_if(F.col("match_date").isNull()), "null_kickoff_time": F.count_if(F.col("kickoff_time").isNull()),
        "null_goals": F.count_if(F.col("home_goals").isNull() | F.col("away_goals").isNull()), "same_team": F.count_if(F.col("home_team") == F.col("away_team")),
        "result_against_goals": F.count_if((F.col("home_goals") > F.col("away_goals")) != (stated == "H")),
    }
    groups = quality.duplicate_groups(rows, ["league", "season", "home_team", "away_team"])
    return quality.named_counts(rows, counts).unionByName(
        groups.select(F.lit("duplicate_fixture_groups").alias("check_name"), F.col("duplicate_groups").alias("bad_rows"))
    )


@query("L1", """
SELECT league, season, count(*) AS matches, (SELECT count(DISTINCT team) FROM team_rows t WHERE t.league = m.league AND t.season = m.season) AS teams,
 count(*) = 380 AND (SELECT count(DISTINCT team) FROM team_rows t WHERE t.league = m.league AND t.season = m.season) = 20 AS complete FROM matches m GROUP BY league, season""")
def season_size_check(tables):
    sizes = tables.matches.groupBy("league", "season").agg(F.count("*").alias("matches"))
    teams = tables.matches.select("league", "season", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    out = sizes.join(teams.groupBy("league", "season").agg(F.count("*").alias("teams")), ["league", "season"])
    return out.withColumn("complete", (F.col("matches") == 380) & (F.col("teams") == 20))


_RULES = {
    "different_teams": "home_team <> away_team",
    "goals_not_negative": "home_goals >= 0 AND away_goals >= 0",
    "xg_below_two": "home_xg < 2 AND away_xg < 2",
    "kickoff_after_2000": "kickoff_time >= TIMESTAMP '2000-01-01 00:00:00'",
}


@query("L2", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({v})) AS violations FROM matches" for k, v in _RULES.items()))
def check_constraints(tables):
    return quality.rule_violations(tables.matches, _RULES)


_CASES = {
    "fixture_and_id": ("fixture_id IS NOT NULL AND player_source_id IS NOT NULL", ["season", "gameweek", "player_source_id", "fixture_id", "source_file"]),
    "fixture_and_name": ("fixture_id IS NOT NULL AND player_source_id IS NULL", ["season", "gameweek", "player_name", "fixture_id", "source_file"]),
    "id_only": ("fixture_id IS NULL AND player_source_id IS NOT NULL", ["season", "gameweek", "player_source_id", "source_file"]),
    "name_only": ("fixture_id IS NULL AND player_source_id IS NULL", ["season", "gameweek", "player_name", "source_file"]),
}


@query("L3", " UNION ALL ".join(
    f"SELECT '{k}' AS case_name, count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM "
    f"(SELECT count(*) AS n FROM history WHERE {c} GROUP BY {', '.join(keys)})" for k, (c, keys) in _CASES.items()))
def conditional_uniqueness(tables):
    return quality.conditional_duplicates(tables.history, {k: (F.expr(c), keys) for k, (c, keys) in _CASES.items()})


@query("L4", """
SELECT 'gameweek_outside_range' AS check_name, count(*) FILTER (gameweek IS NULL OR gameweek < 1 OR gameweek > 11) AS bad_rows FROM history
UNION ALL SELECT 'minutes_negative', count(*) FILTER (minutes < 0) FROM history UNION ALL SELECT 'total_points_null', count(*) FILTER (total_points IS NULL) FROM history
UNION ALL SELECT 'total_points_high', count(*) FILTER (total_points > 12) FROM history UNION ALL SELECT 'value_not_positive', count(*) FILTER (value <= 0) FROM history
UNION ALL SELECT 'seasons_with_many_periods', count(*) FROM (SELECT season FROM history GROUP BY season HAVING count(DISTINCT gameweek) > 8)""")
def period_anomalies(tables):
    week = F.col("gameweek")
    counts = {
        "gameweek_outside_range": F.count_if(week.isNull() | (week < 1) | (week > 11)), "minutes_negative": F.count_if(F.col("minutes") < 0),
        "total_points_null": F.count_if(F.col("total_points").isNull()), "total_points_high": F.count_if(F.col("total_points") > 12),
        "value_not_positive": F.count_if(F.col("value") <= 0),
    }
    many = tables.history.groupBy("season").agg(F.countDistinct("gameweek").alias("n")).filter("n > 8")
    return quality.named_counts(tables.history, counts).unionByName(
        many.agg(F.count("*").alias("bad_rows")).select(F.lit("seasons_with_many_periods").alias("check_name"), "bad_rows")
    )


_READY = [
    ("rows_total_points / rows < 0.999", "target unknown in some rows"), ("rows_minutes / rows < 0.999", "minutes unknown in some rows"), ("rows < 2000", "fewer than 2000 rows"),
    ("source_files < 10", "fewer than 10 files"), ("rows_team_name / rows < 0.95", "team known in under 95 percent"),
    ("rows_position / rows < 0.95", "position known in under 95 percent"),
]


@query("L5", f"""
WITH c AS (SELECT season, count(*) AS rows, count(DISTINCT source_file) AS source_files, count(minutes) AS rows_minutes, count(total_points) AS rows_total_points,
 count(*) FILTER (team_name IS NOT NULL AND trim(team_name) <> '') AS rows_team_name, count(*) FILTER (position IS NOT NULL AND trim(position) <> '') AS rows_position FROM history GROUP BY season),
r AS (SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _READY)}) AS reasons FROM c)
SELECT season, rows, source_files, CASE WHEN reasons = '' THEN 'READY' WHEN rows_total_points / rows >= 0.999 AND rows_minutes / rows >= 0.999 AND rows >= 2000 THEN 'PARTIAL' ELSE 'NOT_READY' END AS status,
 round(rows_minutes / rows, 6) AS minutes_rate, CASE WHEN reasons = '' THEN 'ready' ELSE reasons END AS notes FROM r""")
def training_readiness(tables):
    rows = coverage_by_season(tables)
    reasons = F.concat_ws("; ", *[F.when(F.expr(c), n) for c, n in _READY])
    usable = F.expr("rows_total_points / rows >= 0.999 AND rows_minutes / rows >= 0.999 AND rows >= 2000")
    return rows.withColumn("reasons", reasons).select(
        "season", "rows", "source_files",
        F.when(F.col("reasons") == "", "READY").when(usable, "PARTIAL").otherwise("NOT_READY").alias("status"),
        F.round(F.col("rows_minutes") / F.col("rows"), 6).alias("minutes_rate"),
        F.when(F.col("reasons") == "", "ready").otherwise(F.col("reasons")).alias("notes"),
    )


# ---- independent recomputation -------------------------------------------------------


def _differences(first: str, second: str, keys: str, values: tuple) -> str:
    """Counts of rows on one side only and of differing values between two CTEs."""
    same = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    key = keys.split(", ")[0]
    counts = [("only_left", f"y.{key} IS NULL"), ("only_right", f"x.{key} IS NULL")]
    counts += [(f"differs_{v}", f"x.{key} IS NOT NULL AND y.{key} IS NOT NULL AND (x.{v} IS NULL) <> (y.{v} IS NULL) OR abs(x.{v} - y.{v}) > 1e-9") for v in values]
    return " UNION ALL ".join(f"SELECT '{n}' AS comparison, count(*) FILTER ({c}) AS rows FROM {first} x FULL JOIN {second} y ON {same}" for n, c in counts)


# Once by a window over the earlier rows, once by a join that ranks them.
_FORM_TWICE = f"""
WITH r AS (SELECT league, team, event_time, match_id, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points FROM team_rows),
t AS (SELECT DISTINCT league, team, event_time FROM r),
j AS (SELECT t.league, t.team, t.event_time, r.points, row_number() OVER (PARTITION BY t.league, t.team, t.event_time ORDER BY r.event_time DESC, r.match_id DESC) AS k
 FROM t JOIN r ON r.league = t.league AND r.team = t.team AND r.event_time < t.event_time),
first AS (SELECT t.league, t.team, t.event_time, count(points) AS n5, avg(points) AS points5 FROM t LEFT JOIN j ON j.league = t.league AND j.team = t.team AND j.event_time = t.event_time AND k <= 5
 GROUP BY t.league, t.team, t.event_time),
w AS (SELECT league, team, event_time, count(*) OVER h AS n5, avg(points) OVER h AS points5, row_number() OVER (PARTITION BY league, team, event_time ORDER BY match_id) AS k FROM r
 WINDOW h AS (PARTITION BY league, team ORDER BY event_time, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
second AS (SELECT league, team, event_time, n5, points5 FROM w WHERE k = 1)
{_differences('first', 'second', 'league, team, event_time', ('points5', 'n5'))}"""


@query("L7", _FORM_TWICE)
def form_recomputed(tables):
    """Strict last-5 points once from carried histories, once from running totals at row positions."""
    rows = tables.team_rows.withColumn("points", points_for("goals_for", "goals_against"))
    team = ["league", "team"]
    first = history.prior_strict(rows, team, "event_time", ["match_id"], ["points"], 5).select(
        *team, "event_time", history.history_count(5).alias("n5"), history.history_mean("points", 5).alias("points5")
    )
    placed = positions(rows.select(*team, "event_time", "match_id", "points"), team, "event_time", ["match_id"])
    per_time = placed.groupBy(*team, "event_time").agg(F.min("position").alias("start"))
    totals = running_totals(placed, team, "event_time", ["match_id"], F.col("points"), "total")
    totals = totals.select(*team, (F.col("position") + 1).alias("upto"), "total")
    bounds = per_time.withColumn("low", F.greatest(F.col("start") - 5, F.lit(0)))
    high = totals.withColumnsRenamed({"upto": "start", "total": "high_total"})
    low = totals.withColumnsRenamed({"upto": "low", "total": "low_total"})
    joined = bounds.join(high, [*team, "start"], "left").join(low, [*team, "low"], "left")
    n = F.col("start") - F.col("low")
    second = joined.select(
        *team, "event_time", n.cast("int").alias("n5"),
        F.try_divide(F.coalesce("high_total", F.lit(0)) - F.coalesce("low_total", F.lit(0)), n).alias("points5"),
    )
    return quality.difference(first, second, [*team, "event_time"], ["points5", "n5"], tolerance=1e-9)


@query("L7", TABLE_SQL + f""",
first AS (SELECT r.match_id, r.team, points_before, games_played_before FROM team_rows r JOIN tab t ON t.league = r.league AND t.season = r.season AND t.match_date = r.match_date AND t.team = r.team),
second AS (SELECT match_id, team, coalesce(sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) OVER w, 0) AS points_before, count(*) OVER w AS games_played_before
 FROM team_rows WINDOW w AS (PARTITION BY league, season, team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
{_differences('first', 'second', 'match_id, team', ('points_before', 'games_played_before'))}""")
def standings_recomputed(tables):
    """Points before a match once from the tables by date, once from running totals of the match rows."""
    first = standings.standings_before(tables.team_rows, SEASON).select("match_id", "team", "points_before", "games_played_before")
    rows = tables.team_rows.withColumn("points", points_for("goals_for", "goals_against"))
    second = running_totals(rows, [*SEASON, "team"], "match_date", ["match_id"], F.col("points"), "points")
    games = running_totals(rows, [*SEASON, "team"], "match_date", ["match_id"], F.lit(1), "games")
    second = second.select("match_id", "team", "points_before").join(
        games.select("match_id", "team", F.col("games_before").alias("games_played_before")), ["match_id", "team"]
    )
    return quality.difference(first, second, ["match_id", "team"], ["points_before", "games_played_before"])


@query("L8", f"""
WITH {_COLLAPSED}, f AS (SELECT season, gameweek, {_PRIOR_COLS} FROM c {_PRIOR_WINDOWS})
SELECT count(*) AS rows, count(*) FILTER (history_end_season > season OR (history_end_season = season AND history_end_period >= gameweek)) AS leaking,
 count(*) FILTER (prior_row_count = 0 AND history_end_period IS NOT NULL) AS unexplained FROM f""")
def lineage_check(tables):
    from pastward.operators.periods import prior_only_features

    rows = prior_only_features(collapsed(tables), "player_id", "season", "gameweek", "row_id", **_KW)
    end, now = F.struct("history_end_season", "history_end_period"), F.struct("season", "gameweek")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("history_end_season").isNotNull() & (end >= now)).alias("leaking"),
        F.count_if((F.col("prior_row_count") == 0) & F.col("history_end_period").isNotNull()).alias("unexplained"),
    )


_COVER = ["points_prev1", "points_avg_last3", "points_avg_last5", "xg_avg_last5"]


@query("L11 L28", _PPF_SQL + f""", j AS (SELECT p.season, l.* FROM player_rows p LEFT JOIN l ON l.player_id = p.player_id AND l.gameweek = p.gameweek)
SELECT season, count(*) AS rows, count(*) FILTER (coalesce(history_matches_last5, 0) = 0) AS no_prior_rows, count(*) FILTER (history_matches_last5 >= 3) AS mature_rows,
 {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in _COVER)} FROM j GROUP BY season""")
def feature_coverage(tables):
    rows = _period_features(tables).withColumn("season", F.lit(2024))
    n = F.col("history_matches_last5")
    return rows.groupBy("season").agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("no_prior_rows"), F.count_if(n >= 3).alias("mature_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in _COVER],
    )


# ---- rule lists per feature family ---------------------------------------------------

_BASE_RULES = {
    "counts_in_range": "home_overall_matches_last5 BETWEEN 0 AND 5 AND home_overall_matches_last10 BETWEEN 0 AND 10 AND away_overall_matches_last5 BETWEEN 0 AND 5",
    "rates_in_range": "home_clean_sheet_rate_home_last5 BETWEEN 0 AND 1 AND away_clean_sheet_rate_away_last5 BETWEEN 0 AND 1",
    "null_only_without_history": "(home_overall_matches_last5 = 0) = (home_points_overall_last5 IS NULL)",
    "no_more_in_five_than_in_ten": "home_overall_matches_last5 <= home_overall_matches_last10",
    "points_below_two": "home_points_overall_last10 < 2",
}


def _rules_sql(prefix, rules, source):
    return prefix + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({v})) AS violations FROM {source}" for k, v in rules.items())


@query("L25", _rules_sql(f"WITH b AS ({BASE_SQL.strip()}) ", _BASE_RULES, "b"))
def base_feature_rules(tables):
    rows = rounded(match_features.base_match_features(tables.matches, tables.team_rows, LEAGUE))
    return quality.rule_violations(rows, _BASE_RULES)


_H2H_RULES = {
    "results_add_up": "h2h_matches_prior = h2h_home_wins_prior + h2h_draws_prior + h2h_away_wins_prior",
    "null_only_without_meetings": "(h2h_matches_prior = 0) = (h2h_home_goals_avg_prior IS NULL)",
    "last_meeting_earlier": "h2h_last_meeting_days >= 0",
    "few_meetings": "h2h_matches_prior < 5",
}


@query("L25", _rules_sql(f"WITH b AS ({H2H_SQL.strip()}) ", _H2H_RULES, "b"))
def head_to_head_rules(tables):
    return quality.rule_violations(rounded(pairs.pair_history(tables.matches, LEAGUE)), _H2H_RULES)


_TABLE_RULES = {
    "points_from_results": "points_before = wins_before * 3 + draws_before",
    "games_from_results": "games_played_before = wins_before + draws_before + losses_before",
    "goal_difference": "goal_diff_before = goals_for_before - goals_against_before",
    "points_per_game_known": "(games_played_before = 0) = (ppg_before IS NULL)",
    "rank_in_range": "rank_before BETWEEN 1 AND 20",
    "leader_has_no_gap": "rank_before <> 1 OR points_to_1st_before = 0",
    "few_points": "points_before < 30",
}


@query("L25 L2", _rules_sql(TABLE_SQL, _TABLE_RULES, "tab").replace("FROM g)SELECT", "FROM g) SELECT"))
def standings_rules(tables):
    return quality.rule_violations(standings.tables_by_date(tables.team_rows, SEASON), _TABLE_RULES)


_PRESSURE_RULES = {
    "pressure_in_unit_interval": "pressure_index BETWEEN 0 AND 1",
    "pressure_only_when_mature": "(games_played_before >= 8) = (pressure_index IS NOT NULL)",
    "index_is_largest": "pressure_index >= title_pressure AND pressure_index >= top4_pressure",
    "low_pressure": "pressure_index < 0.2",
}


@query("L25", _rules_sql(_PRESSURE_CTE, _PRESSURE_RULES, "pr").replace("FROM pr0)SELECT", "FROM pr0) SELECT"))
def pressure_rules(tables):
    return quality.rule_violations(standings.pressure(standings.tables_by_date(tables.team_rows, SEASON)), _PRESSURE_RULES)


_ELO_RULES = {
    "expected_scores_sum_to_one": "abs(expected_home_score + expected_away_score - 1) <= 1e-9",
    "actual_scores_sum_to_one": "actual_home_score + actual_away_score = 1",
    "difference": "abs(elo_diff_before - (home_elo_before - away_elo_before)) <= 1e-9",
    "adjusted_difference": "abs(elo_diff_home_adjusted - (elo_diff_before + 50)) <= 1e-9",
    "changes_cancel": "abs(home_elo_delta + away_elo_delta) <= 1e-9",
    "after_is_before_plus_change": "abs(home_elo_after - (home_elo_before + home_elo_delta)) <= 1e-9",
    "first_season_starts_initial": "home_initialization <> 'initial' OR season = 1995",
    "rating_below_1600": "home_elo_before < 1600",
}


@query("L24", elo_cte() + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({v})) AS violations FROM (SELECT *, 1 - expected_home_score AS expected_away_score, 1 - actual_home_score AS actual_away_score, hb_delta AS home_elo_delta, ab_delta AS away_elo_delta FROM elo_full)"
    for k, v in _ELO_RULES.items()))
def elo_rules(tables):
    return quality.rule_violations(ratings.elo(tables.matches), _ELO_RULES)


@query("G10 D4", f"""
{elo_cte(extra=f"bf AS ({BASE_SQL.strip()}), ")} SELECT b.match_id, b.league, b.season, b.home_overall_matches_last5, b.away_overall_matches_last5, b.home_points_overall_last5, b.away_points_overall_last5,
 b.home_xg_overall_last5, b.away_xg_overall_last5, round(home_elo_before, 4) AS home_elo_before, round(away_elo_before, 4) AS away_elo_before,
 round(elo_diff_home_adjusted, 4) + 0.0 AS elo_diff_home_adjusted, round(expected_home_score, 4) AS expected_home_score FROM bf b JOIN elo_full e ON e.match_id = b.match_id""")
def match_features_with_elo(tables):
    base = rounded(match_features.base_match_features(tables.matches, tables.team_rows, LEAGUE))
    elo = rounded(ratings.elo(tables.matches), 4)
    cols = ["home_overall_matches_last5", "away_overall_matches_last5", "home_points_overall_last5", "away_points_overall_last5", "home_xg_overall_last5", "away_xg_overall_last5"]
    added = ["home_elo_before", "away_elo_before", "elo_diff_home_adjusted", "expected_home_score"]
    out = joins.one_to_one(base.select("match_id", "league", "season", *cols), elo.select("match_id", *added), ["match_id"])
    found = quality.check_features(out, cols + added, ["home_goals", "away_goals", "result"], ["_after", "_delta"])
    if found:
        raise ValueError("; ".join(found))
    return out


_UPCOMING_RULES = {
    "different_teams": "home_team <> away_team",
    "has_date": "match_date IS NOT NULL",
    "probabilities_in_range": "p_home BETWEEN 0 AND 1 AND p_draw BETWEEN 0 AND 1 AND p_away BETWEEN 0 AND 1",
    "probabilities_sum_to_one": "abs(p_home + p_draw + p_away - 1) <= 0.000001",
    "known_labels": "argmax_prediction IN ('H', 'D', 'A') AND overlay_prediction IN ('H', 'D', 'A')",
    "confidence_in_range": "confidence >= 0 AND confidence <= 1",
    "confident": "confidence >= 0.5",
}


@query("L26 L23", f"""
WITH n AS (SELECT *, greatest(p_home, p_draw, p_away) AS confidence, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS argmax_prediction FROM preds),
o AS (SELECT *, argmax_prediction AS overlay_prediction FROM n) """ + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({v})) AS violations FROM o" for k, v in _UPCOMING_RULES.items()))
def prediction_row_rules(tables):
    return quality.rule_violations(prediction_rows(tables.preds, 0.24), _UPCOMING_RULES)


# ---- status --------------------------------------------------------------------------


@query("L21", """
SELECT 'matches' AS source, CAST(max(season) AS VARCHAR) AS latest_run, count(*) AS rows FROM matches UNION ALL SELECT 'snapshots', CAST(max(run_id) AS VARCHAR), count(*) FROM snapshots
UNION ALL SELECT 'history', max(season), count(*) FROM history UNION ALL SELECT 'player_rows', CAST(max(season) AS VARCHAR), count(*) FROM player_rows""")
def pipeline_status(tables):
    out = None
    for name, column in (("matches", "season"), ("snapshots", "run_id"), ("history", "season"), ("player_rows", "season")):
        one = getattr(tables, name).agg(F.max(column).cast("string").alias("latest_run"), F.count("*").alias("rows"))
        one = one.select(F.lit(name).alias("source"), "latest_run", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("L22", """
SELECT DISTINCT c_mktsegment AS team_name, CASE WHEN c_mktsegment LIKE '%BUILD%' THEN 'run_1:cold_start' ELSE 'run_1' END AS source FROM customer WHERE c_mktsegment LIKE '%BUILD%'""")
def cold_start_teams(tables):
    source = F.when(F.col("c_mktsegment").like("%BUILD%"), "run_1:cold_start").otherwise("run_1")
    rows = tables.read("customer").select(F.col("c_mktsegment").alias("team_name"), source.alias("source"))
    return rows.filter(F.col("source").like("%cold_start")).distinct()


@query("L27", """
SELECT m.league, count(*) AS rows, count(n.n_nationkey) AS mapped_home, count(*) - count(n.n_nationkey) AS unmapped_home FROM matches m LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) n ON n.n_nationkey = m.home_team GROUP BY m.league""")
def name_coverage(tables):
    names = tables.read("nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("home_team"), F.lit(1).alias("k"))
    rows = tables.matches.select("league", "home_team").join(names, "home_team", "left")
    return rows.groupBy("league").agg(
        F.count("*").alias("rows"), F.count("k").alias("mapped_home"), F.count_if(F.col("k").isNull()).alias("unmapped_home")
    )


@query("L29", """
WITH c AS (SELECT season, count(*) AS rows FROM matches GROUP BY season), t AS (SELECT max(season) AS last FROM c)
SELECT CAST(season AS VARCHAR) AS part, rows, rows >= 1900 AS as_expected FROM c UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT), sum(rows) >= 15000 FROM c
UNION ALL SELECT 'holdout', rows, rows >= 1900 FROM c, t WHERE season = last""")
def source_metadata(tables):
    per = tables.matches.groupBy("season").agg(F.count("*").alias("rows"))
    one = per.agg(F.sum("rows").alias("total"), F.max_by("rows", "season").alias("holdout"))
    extra = struct_rows(one, [F.struct(F.lit(c).alias("part"), F.col(c).alias("rows"), F.lit(n).alias("_want")) for c, n in (("total", 15000), ("holdout", 1900))])
    out = per.select(F.col("season").cast("string").alias("part"), "rows", F.lit(1900).alias("_want")).unionByName(extra)
    return out.select("part", "rows", (F.col("rows") >= F.col("_want")).alias("as_expected"))


@query("L30", """
WITH s AS (SELECT player_id AS source, max(snapshot_date) FILTER (status <> 'F') AS last_success, arg_max(CASE WHEN status = 'P' THEN 'pending' END, snapshot_id) FILTER (status = 'P') AS error FROM snapshots GROUP BY player_id)
SELECT source, last_success, error FROM s WHERE error IS NOT NULL OR last_success IS NULL OR CAST(last_success AS TIMESTAMP) < TIMESTAMP '2001-06-01 00:00:00' - INTERVAL '48' HOUR""")
def freshness_warnings(tables):
    ok = F.when(F.col("status") != "F", F.col("snapshot_date"))
    rows = tables.snapshots.groupBy(F.col("player_id").alias("source")).agg(
        F.max(ok).alias("last_success"), F.max(F.when(F.col("status") == "P", "pending")).alias("error")
    )
    limit = F.expr("TIMESTAMP '2001-06-01 00:00:00' - INTERVAL '48' HOUR")
    return rows.filter(F.col("error").isNotNull() | F.col("last_success").isNull() | (F.col("last_success").cast("timestamp") < limit))


# ---- identity ------------------------------------------------------------------------

_NORM = "trim(regexp_replace(trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g')), ' [0-9]+$', ''))"


def _mode(c):
    return (f"(SELECT season, player_source_id, {c} FROM (SELECT season, player_source_id, {c}, count(*) AS n FROM known WHERE {c} IS NOT NULL GROUP BY ALL) "
            f"QUALIFY row_number() OVER (PARTITION BY season, player_source_id ORDER BY n DESC, {c}) = 1)")


SUMMARY = f"""
known AS (SELECT * FROM history WHERE player_source_id IS NOT NULL AND trim(player_source_id) <> ''),
tot AS (SELECT season, player_source_id, count(DISTINCT nullif(trim(team_name), '')) AS distinct_team_names, count(DISTINCT nullif(trim(position), '')) AS distinct_positions,
 min(gameweek) AS first_gameweek, max(gameweek) AS last_gameweek, count(*) AS row_count, CAST(coalesce(sum(minutes), 0) AS BIGINT) AS minutes_total,
 CAST(coalesce(sum(total_points), 0) AS BIGINT) AS points_total FROM known GROUP BY season, player_source_id),
summ AS (SELECT tot.*, a.player_name, b.team_name, c.position FROM tot LEFT JOIN {_mode('player_name')} a USING (season, player_source_id)
 LEFT JOIN {_mode('team_name')} b USING (season, player_source_id) LEFT JOIN {_mode('position')} c USING (season, player_source_id))"""
JOINED = SUMMARY + f""",
j AS (SELECT s.*, m.code, m.name_raw, m.position_raw, CASE WHEN m.code IS NOT NULL THEN 'element_id_exact' ELSE 'unmatched' END AS mapping_method,
 CASE WHEN m.code IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence_score, CASE WHEN s.season NOT IN (SELECT season FROM master) THEN 'no_players_raw_csv_for_season' WHEN m.code IS NULL THEN 'unmatched_player_source_id' END AS join_reason,
 {_NORM.format(c='s.player_name')} AS normalized_name, {_NORM.format(c='m.name_raw')} AS norm_raw FROM summ s LEFT JOIN master m ON m.season = s.season AND m.element_id = s.player_source_id),
nn AS (SELECT code, count(DISTINCT normalized_name) AS names FROM j WHERE code IS NOT NULL GROUP BY code),
sc AS (SELECT season, code, count(*) AS same_code, count(DISTINCT normalized_name) AS season_names, count(DISTINCT team_name) AS teams FROM j WHERE code IS NOT NULL GROUP BY season, code),
ss AS (SELECT season, player_source_id, count(*) AS same_source FROM j GROUP BY season, player_source_id),
fl AS (SELECT j.*, concat_ws('; ', join_reason, CASE WHEN same_source > 1 THEN 'duplicate_season_player_source_id' END, CASE WHEN same_code > 1 THEN 'duplicate_season_fpl_code' END,
 CASE WHEN names > 1 THEN 'fpl_code_multiple_names' END, CASE WHEN season_names > 1 THEN 'fpl_code_multiple_players_one_season' END,
 CASE WHEN j.code IS NOT NULL AND normalized_name <> '' AND norm_raw <> '' AND normalized_name <> norm_raw THEN 'conflicting_player_name' END,
 CASE WHEN j.code IS NOT NULL AND upper(trim(position)) <> '' AND upper(trim(position_raw)) <> '' AND upper(trim(position)) <> upper(trim(position_raw)) THEN 'conflicting_position' END,
 CASE WHEN distinct_team_names > 1 THEN 'conflicting_team_mappings' END, CASE WHEN distinct_positions > 1 THEN 'conflicting_position_mappings' END,
 CASE WHEN teams > 1 THEN 'same_season_team_overlap' END) AS reason
 FROM j LEFT JOIN nn ON nn.code = j.code LEFT JOIN sc ON sc.season = j.season AND sc.code = j.code JOIN ss ON ss.season = j.season AND ss.player_source_id = j.player_source_id),
idmap AS (SELECT CASE WHEN mapping_method = 'element_id_exact' THEN CAST(code AS VARCHAR) END AS canonical_key, code, season, player_source_id, player_name,
 CASE WHEN normalized_name = '' THEN 'unknown' ELSE normalized_name END AS normalized_name, team_name, position, first_gameweek, last_gameweek, row_count, minutes_total, points_total,
 mapping_method, confidence_score, reason <> '' AS needs_manual_review, nullif(reason, '') AS review_reason FROM fl)"""


@query("L12", f"WITH {SUMMARY} SELECT * FROM summ")
def player_history_summary(tables):
    return identity.history_summary(tables.history)


@query("L13", f"WITH {JOINED} SELECT season, player_source_id, code, name_raw, position_raw, mapping_method, confidence_score, join_reason FROM j")
def identity_join(tables):
    rows = identity.identity_join(identity.history_summary(tables.history), tables.master)
    return rows.select("season", "player_source_id", "code", "name_raw", "position_raw", "mapping_method", "confidence_score", F.col("_join_reason").alias("join_reason"))


def _map(tables):
    # One row per player and season from here on, used by several aggregates.
    joined = materialize(identity.identity_join(identity.history_summary(tables.history), tables.master))
    return identity.identity_map(identity.conflict_flags(joined))


@query("L14 L15 C8", f"WITH {JOINED} SELECT * FROM idmap")
def identity_map(tables):
    return _map(tables)


@query("L16", f"""
WITH {JOINED} SELECT 'map_rows' AS check_name, count(*) AS value FROM idmap UNION ALL SELECT 'represented_rows', CAST(sum(row_count) AS BIGINT) FROM idmap
UNION ALL SELECT 'without_key', count(*) FILTER (canonical_key IS NULL) FROM idmap UNION ALL SELECT 'to_review', count(*) FILTER (needs_manual_review) FROM idmap
UNION ALL SELECT 'orphan_rows', count(*) FROM known k WHERE NOT EXISTS (SELECT 1 FROM idmap i WHERE i.season = k.season AND i.player_source_id = k.player_source_id)""")
def identity_map_checks(tables):
    out = None
    for part in identity.map_checks(_map(tables), tables.history).values():
        rows = struct_rows(part, [F.struct(F.lit(c).alias("check_name"), F.col(c).alias("value")) for c in part.columns])
        out = rows if out is None else out.unionByName(rows)
    return out


