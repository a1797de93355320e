"""Joins, aggregates and set operations."""

from pyspark.sql import functions as F

from pastward.functions.scalars import outcome, ratio
from pastward.operators import aggregates, joins, quality
from pastward.operators.reshape import metric_rows, team_rows
from pastward.plans.common import rounded
from pastward.plans.history import _FORM_SQL, _XG_SQL, FORM_COLUMNS, team_form
from pastward.plans.registry import query

# ---- joins ---------------------------------------------------------------------------

# The xG feed: the same matches known by date and team names, some missing.
_FEED = "SELECT season, league, match_date, home_team, away_team, match_id AS feed_id, home_xg, away_xg FROM matches WHERE away_xg >= 0.05"


def feed(tables):
    return tables.matches.filter(F.col("away_xg") >= 0.05).select(
        "season", "league", "match_date", "home_team", "away_team", F.col("match_id").alias("feed_id"), "home_xg", "away_xg"
    )


_KEY = ["season", "league", "match_date", "home_team", "away_team"]


@query("D1", f"""
WITH feed AS ({_FEED}) SELECT m.match_id, f.feed_id, m.season, m.league, m.match_date, m.home_team, m.away_team, m.home_goals, m.away_goals, f.home_xg, f.away_xg
FROM matches m JOIN feed f USING (season, league, match_date, home_team, away_team)""")
def matches_with_feed(tables):
    results = tables.matches.select("match_id", *_KEY, "home_goals", "away_goals")
    return joins.guarded_inner(results, feed(tables), _KEY, complete=False, unique=False)


@query("D4 D6", f"""
WITH feed AS ({_FEED}), a AS (SELECT DISTINCT season, league, match_date, home_team, away_team, 1 AS l FROM matches),
b AS (SELECT DISTINCT season, league, match_date, home_team, away_team, 1 AS r FROM feed)
SELECT count(*) FILTER (l = 1 AND r = 1) AS matched, count(*) FILTER (r IS NULL) AS only_in_results, count(*) FILTER (l IS NULL) AS only_in_feed
FROM a FULL JOIN b USING (season, league, match_date, home_team, away_team)""")
def feed_coverage(tables):
    return quality.coverage(tables.matches, feed(tables), _KEY, ("results", "feed"))


@query("D6 J3", f"""
WITH feed AS ({_FEED}) SELECT match_id, match_date, home_team, away_team FROM matches m WHERE NOT EXISTS (SELECT 1 FROM feed f
 WHERE f.season = m.season AND f.league = m.league AND f.match_date = m.match_date AND f.home_team = m.home_team AND f.away_team = m.away_team)
ORDER BY match_date, match_id LIMIT 20""")
def unmatched_examples(tables):
    rows = joins.unmatched(tables.matches, feed(tables), _KEY)
    return rows.select("match_id", "match_date", "home_team", "away_team").orderBy("match_date", "match_id").limit(20)


@query("D2 D12", """
WITH x AS (SELECT m.match_id, m.match_date, h.n_name AS home_name, a.n_name AS away_name, m.home_xg, m.away_xg, m.home_goals, m.away_goals FROM matches m
 JOIN nation h ON h.n_nationkey = m.home_team JOIN nation a ON a.n_nationkey = m.away_team)
SELECT match_id, match_date, 'H' AS venue, home_name AS team_name, away_name AS opponent_name, home_xg AS team_xg, away_xg AS opponent_xg, home_goals AS goals_for, away_goals AS goals_against FROM x
UNION ALL SELECT match_id, match_date, 'A', away_name, home_name, away_xg, home_xg, away_goals, home_goals FROM x""")
def named_team_rows(tables):
    names = tables.read("nation").select(F.col("n_nationkey").alias("k"), "n_name")
    rows = tables.matches
    for side in ("home", "away"):
        rows = rows.join(names.withColumnsRenamed({"k": f"{side}_team", "n_name": f"{side}_name"}), f"{side}_team")
    return team_rows(rows, ["match_id", "match_date"], {
        "team_name": ("home_name", "away_name"), "opponent_name": ("away_name", "home_name"), "team_xg": ("home_xg", "away_xg"),
        "opponent_xg": ("away_xg", "home_xg"), "goals_for": ("home_goals", "away_goals"), "goals_against": ("away_goals", "home_goals"),
    })


_PAIRS = """
SELECT league, home_team, away_team, count(*) AS meetings, count(*) FILTER (home_goals > away_goals) AS home_wins, count(*) FILTER (home_goals < away_goals) AS away_wins,
 count(*) FILTER (home_goals = away_goals) AS draws, CAST(round(CAST(avg(CAST(home_goals > away_goals AS INT)) AS DECIMAL(38,10)), 2) AS DOUBLE) AS home_win_rate,
 CAST(round(CAST(avg(home_goals) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_home_goals, CAST(round(CAST(avg(away_goals) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_away_goals
FROM matches GROUP BY league, home_team, away_team"""


@query("E2", _PAIRS)
def ordered_pair_summary(tables):
    return aggregates.ordered_pair_summary(tables.matches, ["league"])


@query("D3 C6 C7", f"""
WITH hf AS ({_FORM_SQL.format(s='home', o='away')}), af AS ({_FORM_SQL.format(s='away', o='home')}),
hx AS ({_XG_SQL.format(s='home', v='H')}), ax AS ({_XG_SQL.format(s='away', v='A')}), pr AS ({_PAIRS})
SELECT m.match_id, m.league, m.home_team, m.away_team, hn.n_name AS home_name, an.n_name AS away_name, m.home_goals, m.away_goals,
 CASE WHEN m.home_goals > m.away_goals THEN 'H' WHEN m.home_goals < m.away_goals THEN 'A' ELSE 'D' END AS result,
 home_form_scored, home_form_conceded, home_clean_sheet_rate, away_form_scored, away_form_conceded, away_clean_sheet_rate,
 meetings, home_win_rate, avg_home_goals, avg_away_goals, coalesce(home_xg_last5, 0.0) AS home_xg_last5, coalesce(home_xga_last5, 0.0) AS home_xga_last5,
 coalesce(away_xg_last5, 0.0) AS away_xg_last5, coalesce(away_xga_last5, 0.0) AS away_xga_last5
FROM matches m LEFT JOIN hf ON hf.match_id = m.match_id LEFT JOIN af ON af.match_id = m.match_id LEFT JOIN hx ON hx.match_id = m.match_id
LEFT JOIN ax ON ax.match_id = m.match_id LEFT JOIN nation hn ON hn.n_nationkey = m.home_team LEFT JOIN nation an ON an.n_nationkey = m.away_team
LEFT JOIN pr ON pr.league = m.league AND pr.home_team = m.home_team AND pr.away_team = m.away_team""")
def master_match_features(tables):
    names = tables.read("nation").select(F.col("n_nationkey").alias("k"), "n_name")
    out = tables.matches.select(
        "match_id", "league", "home_team", "away_team", "home_goals", "away_goals", outcome("home_goals", "away_goals").alias("result")
    )
    form = team_form(tables)
    for side, venue in (("home", "H"), ("away", "A")):
        part = form.filter(F.col("venue") == venue).select("match_id", *[F.col(c).alias(f"{side}_{c}") for c in FORM_COLUMNS])
        out = out.join(part, "match_id", "left")
    for side in ("home", "away"):
        out = out.join(names.withColumnsRenamed({"k": f"{side}_team", "n_name": f"{side}_name"}), f"{side}_team", "left")
    pairs = aggregates.ordered_pair_summary(tables.matches, ["league"]).drop("home_wins", "away_wins", "draws")
    out = out.join(pairs, ["league", "home_team", "away_team"], "left")
    return out.fillna(0.0, subset=["home_xg_last5", "home_xga_last5", "away_xg_last5", "away_xga_last5"])


# Predictions whose id is partly unknown: one in three must be matched by its natural key.
_OPEN = """
pred AS (SELECT match_id * 10 AS prediction_id, CASE WHEN home_goals <> 2 THEN match_id END AS match_id, season, match_date, home_team, away_team FROM matches),
res AS (SELECT match_id, season, match_date, home_team, away_team, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS actual
 FROM matches WHERE season <= 1998)"""


def open_predictions(tables):
    rows = tables.matches
    pred = rows.filter("season <= 1999").select(
        (F.col("match_id") * 10).alias("prediction_id"), F.when(F.col("home_goals") != 2, F.col("match_id")).alias("match_id"),
        "season", "match_date", "home_team", "away_team",
    )
    res = rows.filter("season <= 1998").select(
        "match_id", "season", "match_date", "home_team", "away_team", outcome("home_goals", "away_goals").alias("actual")
    )
    return pred, res


_NATURAL = ["season", "match_date", "home_team", "away_team"]
TWO_STAGE_SQL = f"""
WITH {_OPEN}, k AS (SELECT season, match_date, home_team, away_team, arg_min(actual, match_id) AS actual FROM res GROUP BY ALL)
SELECT p.*, CASE WHEN r.match_id IS NOT NULL THEN r.actual ELSE k.actual END AS actual, CASE WHEN r.match_id IS NOT NULL THEN 'id' ELSE 'natural_key' END AS matched_by
FROM pred p LEFT JOIN res r ON r.match_id = p.match_id
LEFT JOIN (SELECT season, match_date, home_team, away_team, arg_min(actual, match_id) AS actual FROM res GROUP BY season, match_date, home_team, away_team) k
 ON k.season = p.season AND k.match_date = p.match_date AND k.home_team = p.home_team AND k.away_team = p.away_team
WHERE r.match_id IS NOT NULL OR k.actual IS NOT NULL""".replace(
    ", k AS (SELECT season, match_date, home_team, away_team, arg_min(actual, match_id) AS actual FROM res GROUP BY ALL)", ""
)


@query("D7", TWO_STAGE_SQL)
def two_stage_match(tables):
    pred, res = open_predictions(tables)
    return joins.two_stage(pred, res, "prediction_id", "match_id", _NATURAL, ["match_id"], ["actual"])


@query("D10", "SELECT match_id, season, league FROM matches WHERE league IN (SELECT r_regionkey FROM region WHERE r_name IN ('EUROPE', 'ASIA'))")
def matches_of_listed_leagues(tables):
    wanted = tables.read("region").filter(F.col("r_name").isin("EUROPE", "ASIA")).select(F.col("r_regionkey").alias("league"))
    return tables.matches.select("match_id", "season", "league").join(wanted, "league", "left_semi")


@query("D11", """
SELECT s.snapshot_id, s.run_id, s.player_id, s.status FROM snapshots s
JOIN (SELECT run_id, status FROM snapshots GROUP BY run_id, status ORDER BY run_id DESC, max(snapshot_date) DESC, status LIMIT 1) t ON t.run_id = s.run_id AND t.status = s.status""")
def rows_of_latest_target(tables):
    rows = tables.snapshots.select("snapshot_id", "run_id", "player_id", "status", "snapshot_date")
    newest = rows.groupBy("run_id", "status").agg(F.max("snapshot_date").alias("d"))
    newest = newest.orderBy(F.col("run_id").desc(), F.col("d").desc(), "status").limit(1).select("run_id", "status")
    return rows.drop("snapshot_date").join(F.broadcast(newest), ["run_id", "status"])  # one row


@query("D13", """
WITH e AS (SELECT *, max(coalesce(end_date, DATE '9999-12-31')) OVER (PARTITION BY team_id ORDER BY start_date, end_date NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM tenures)
SELECT count(*) AS tenures, count(*) FILTER (start_date <= p) AS overlapping, count(*) FILTER (start_date > end_date) AS invalid FROM e""")
def tenure_overlaps(tables):
    rows = joins.overlaps(tables.tenures, ["team_id"], "start_date", "end_date")
    return rows.agg(F.count("*").alias("tenures"), F.count_if("overlaps").alias("overlapping"), F.count_if("invalid_range").alias("invalid"))


@query("D14 L10", """
WITH stored AS (SELECT player_id, gameweek, CASE WHEN player_id % 50 = 0 THEN NULL ELSE sum(total_points) + CAST(player_id % 40 = 0 AS INT) END AS target FROM player_rows GROUP BY player_id, gameweek),
now_ AS (SELECT player_id, gameweek, sum(total_points) AS target FROM player_rows GROUP BY player_id, gameweek)
SELECT s.player_id, s.gameweek, CAST(s.target AS BIGINT) AS stored, CAST(n.target AS BIGINT) AS recomputed FROM stored s JOIN now_ n ON n.player_id = s.player_id AND n.gameweek = s.gameweek
WHERE s.target IS DISTINCT FROM n.target""")
def target_recompute_mismatches(tables):
    now = tables.player_rows.groupBy("player_id", "gameweek").agg(F.sum("total_points").alias("recomputed"))
    player = F.col("player_id")
    stored = now.select("player_id", "gameweek", F.when(player % 50 != 0, F.col("recomputed") + (player % 40 == 0).cast("int")).alias("stored"))
    return stored.join(now, ["player_id", "gameweek"]).filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


@query("D15", """
WITH l AS (SELECT match_id, home_xg, away_xg FROM matches WHERE home_goals < 4), r AS (SELECT match_id, CASE WHEN away_goals = 3 THEN NULL ELSE home_xg END AS home_xg,
 away_xg + CAST(away_goals = 2 AS INT) AS away_xg FROM matches WHERE home_goals > 0),
j AS (SELECT l.match_id AS a, r.match_id AS b, l.home_xg AS lh, r.home_xg AS rh, l.away_xg AS la, r.away_xg AS ra FROM l FULL JOIN r ON r.match_id = l.match_id)
SELECT 'only_left' AS comparison, count(*) FILTER (b IS NULL) AS rows FROM j UNION ALL SELECT 'only_right', count(*) FILTER (a IS NULL) FROM j
UNION ALL SELECT 'differs_home_xg', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND lh IS DISTINCT FROM rh) FROM j
UNION ALL SELECT 'differs_away_xg', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND la IS DISTINCT FROM ra) FROM j""")
def full_outer_comparison(tables):
    rows = tables.matches
    left = rows.filter("home_goals < 4").select("match_id", "home_xg", "away_xg")
    right = rows.filter("home_goals > 0").select(
        "match_id", F.when(F.col("away_goals") != 3, F.col("home_xg")).alias("home_xg"),
        (F.col("away_xg") + (F.col("away_goals") == 2).cast("int")).alias("away_xg"),
    )
    return quality.difference(left, right, ["match_id"], ["home_xg", "away_xg"])


@query("F20 C5 D5", """
SELECT c.player_id, c.team_id, n.n_name AS team_name, c.position, c.expected_points, c.now_cost / 10.0::DOUBLE AS price,
 CAST(round(CAST(c.expected_points / nullif(c.now_cost / 10.0::DOUBLE, 0) AS DECIMAL(38,10)), 2) AS DOUBLE) AS points_per_million
FROM candidates c LEFT JOIN nation n ON n.n_nationkey = c.team_id""")
def player_value_features(tables):
    names = tables.read("nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"))
    rows = tables.candidates.withColumn("price", F.col("now_cost") / 10.0).drop("now_cost")
    return joins.many_to_one(rows, names, ["team_id"]).withColumn("points_per_million", ratio("expected_points", "price", 2))


# ---- aggregates ----------------------------------------------------------------------


def _side(side, other, venue):
    return f"""SELECT league, season, {side}_team AS team, '{venue}' AS venue, count(*) AS total_matches, CAST(sum({side}_goals) AS BIGINT) AS goals_scored,
 CAST(sum({other}_goals) AS BIGINT) AS goals_conceded, count(*) FILTER ({side}_goals > {other}_goals) AS wins, count(*) FILTER ({side}_goals = {other}_goals) AS draws,
 count(*) FILTER ({other}_goals = 0) AS clean_sheets, CAST(round(CAST(avg({side}_goals) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_goals_scored,
 CAST(round(CAST(avg({other}_goals) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_goals_conceded FROM matches GROUP BY league, season, {side}_team"""


@query("E1 J1", _side("home", "away", "H") + " UNION ALL " + _side("away", "home", "A"))
def side_season_summary(tables):
    return aggregates.side_season_summary(tables.matches, ["league", "season"])


_PRESENT_TEAM = "team_name IS NOT NULL AND trim(team_name) <> ''"
_PRESENT_POS = "position IS NOT NULL AND trim(position) <> ''"


@query("E5 E6 E21", f"""
SELECT season, count(*) AS rows, count(DISTINCT player_name) AS distinct_players, min(gameweek) AS min_gameweek, max(gameweek) AS max_gameweek,
 count(DISTINCT source_file) AS source_files, count(minutes) AS rows_minutes, count(total_points) AS rows_total_points,
 count(*) FILTER ({_PRESENT_TEAM}) AS rows_team_name, count(*) FILTER ({_PRESENT_POS}) AS rows_position, count(expected_goals) AS rows_expected_goals FROM history GROUP BY season""")
def season_coverage(tables):
    return coverage_by_season(tables)


def coverage_by_season(tables):
    from pastward.functions.scalars import is_present

    return tables.history.groupBy("season").agg(
        F.count("*").alias("rows"), F.countDistinct("player_name").alias("distinct_players"), F.min("gameweek").alias("min_gameweek"),
        F.max("gameweek").alias("max_gameweek"), F.countDistinct("source_file").alias("source_files"), F.count("minutes").alias("rows_minutes"),
        F.count("total_points").alias("rows_total_points"), F.count_if(is_present("team_name")).alias("rows_team_name"),
        F.count_if(is_present("position")).alias("rows_position"), F.count("expected_goals").alias("rows_expected_goals"),
    )


@query("E7 E23", """
SELECT league, season, count(DISTINCT match_id) AS matches, count(DISTINCT team) AS teams, min(match_date) AS first_date, max(match_date) AS last_date FROM team_rows GROUP BY league, season""")
def season_summary(tables):
    # Two plain aggregates instead of two distinct counts over doubled rows.
    rows = tables.matches.groupBy("league", "season").agg(
        F.count("*").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")
    )
    teams = tables.matches.select("league", "season", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return rows.join(teams.groupBy("league", "season").agg(F.count("*").alias("teams")), ["league", "season"])


@query("E8", "SELECT league, season, match_date, home_team, count(*) AS rows FROM matches GROUP BY league, season, match_date, home_team HAVING count(*) > 1")
def duplicate_fixtures(tables):
    return quality.duplicates(tables.matches, ["league", "season", "match_date", "home_team"])


@query("E9", """
SELECT season, player_source_id, (SELECT 1) IS NOT NULL AS counted, n.player_name, t.team_name, p.position FROM
 (SELECT season, player_source_id, player_name FROM (SELECT season, player_source_id, player_name, count(*) AS c FROM history WHERE player_name IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY season, player_source_id ORDER BY c DESC, player_name) = 1) n
 LEFT JOIN (SELECT season, player_source_id, team_name FROM (SELECT season, player_source_id, team_name, count(*) AS c FROM history WHERE team_name IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY season, player_source_id ORDER BY c DESC, team_name) = 1) t USING (season, player_source_id)
 LEFT JOIN (SELECT season, player_source_id, position FROM (SELECT season, player_source_id, position, count(*) AS c FROM history WHERE position IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY season, player_source_id ORDER BY c DESC, position) = 1) p USING (season, player_source_id)
WHERE player_source_id IS NOT NULL""".replace("(SELECT 1) IS NOT NULL AS counted, ", ""))
def modes_per_player(tables):
    rows = tables.history.filter(F.col("player_source_id").isNotNull())
    return aggregates.modes(rows, ["season", "player_source_id"], ["player_name", "team_name", "position"])


@query("E11", """
SELECT 'total_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM history UNION ALL SELECT 'seasons', CAST(count(DISTINCT season) AS VARCHAR) FROM history
UNION ALL SELECT 'min_season', min(season) FROM history UNION ALL SELECT 'max_season', max(season) FROM history
UNION ALL SELECT 'min_gameweek', CAST(min(gameweek) AS VARCHAR) FROM history UNION ALL SELECT 'max_gameweek', CAST(max(gameweek) AS VARCHAR) FROM history
UNION ALL SELECT 'distinct_player_name', CAST(count(DISTINCT player_name) AS VARCHAR) FROM history
UNION ALL SELECT 'distinct_source_file', CAST(count(DISTINCT source_file) AS VARCHAR) FROM history""")
def history_metrics(tables):
    one = tables.history.agg(
        F.count("*").alias("total_rows"), F.countDistinct("season").alias("seasons"), F.min("season").alias("min_season"),
        F.max("season").alias("max_season"), F.min("gameweek").alias("min_gameweek"), F.max("gameweek").alias("max_gameweek"),
        F.countDistinct("player_name").alias("distinct_player_name"), F.countDistinct("source_file").alias("distinct_source_file"),
    )
    return metric_rows(one)


_NULLS = ["season", "player_name", "team_name", "position", "fixture_id", "minutes", "total_points", "expected_goals"]
_TEXT = ["season", "player_name", "team_name", "position"]


def _null_sql(by):
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS column_name, count(*) FILTER ({c} IS NULL{f' OR trim({c}) = {chr(39) * 2}' if c in _TEXT else ''}) AS null_count, "
        f"round(count(*) FILTER ({c} IS NULL{f' OR trim({c}) = {chr(39) * 2}' if c in _TEXT else ''}) / count(*), 6) AS null_rate FROM history{tail}"
        for c in _NULLS
    )


@query("E13", _null_sql(""))
def null_profile(tables):
    return quality.null_profile(tables.history, _NULLS, _TEXT)


@query("E13 L11", _null_sql("season").replace("SELECT season, 'season'", "SELECT season, 'season'"))
def null_profile_by_season(tables):
    return quality.null_profile(tables.history.withColumn("_s", F.col("season")), _NULLS, _TEXT, ["_s"]).withColumnRenamed("_s", "season")


@query("E14", """
SELECT match_id, count(*) FILTER (venue = 'H') AS "H", count(*) FILTER (venue = 'A') AS "A" FROM team_rows GROUP BY match_id""")
def venue_cross_tab(tables):
    return aggregates.cross_tab(tables.team_rows, ["match_id"], "venue", ["H", "A"])


_LEFT, _RIGHT = ["home_xg", "away_xg", "home_goals", "known_home_xg", "constant"], ["away_goals", "home_xg"]


@query("E17", f"""
WITH m AS (SELECT *, CASE WHEN away_goals > 0 THEN home_xg END AS known_home_xg, 1 AS constant FROM matches), c AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature, '{b}' AS base_feature, CASE WHEN min({a}) < max({a}) THEN corr({a}, {b}) END AS c, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS paired_rows FROM m"
    for a in _LEFT for b in _RIGHT)})
SELECT feature, base_feature, round(c, 6) + 0.0 AS corr, paired_rows, round(abs(c), 6) AS abs_corr, abs(c) >= 0.95 AS redundant FROM c WHERE c IS NOT NULL""")
def feature_correlations(tables):
    rows = tables.matches.withColumns({"known_home_xg": F.when(F.col("away_goals") > 0, F.col("home_xg")), "constant": F.lit(1)})
    return rounded(aggregates.correlations(rows, _LEFT, _RIGHT))


@query("E20", """
SELECT run_id, count(*) AS rows, count(DISTINCT player_id) AS players, max(snapshot_date) AS snapshot_date FROM snapshots GROUP BY run_id ORDER BY run_id DESC LIMIT 1""")
def latest_run(tables):
    return aggregates.latest_run(tables.snapshots, "run_id", [
        F.count("*").alias("rows"), F.countDistinct("player_id").alias("players"), F.max("snapshot_date").alias("snapshot_date")
    ])


@query("E25", "SELECT season, match_date, count(*) AS fixtures FROM matches GROUP BY season, match_date")
def rows_per_period(tables):
    return tables.matches.groupBy("season", "match_date").agg(F.count("*").alias("fixtures"))


@query("E21", "SELECT run_id, month(snapshot_date) AS period, count(*) AS rows, count(DISTINCT player_id) AS players FROM snapshots GROUP BY run_id, month(snapshot_date)".replace("month(snapshot_date) AS period", "CAST(month(snapshot_date) AS INT) AS period"))
def snapshot_coverage(tables):
    return tables.snapshots.groupBy("run_id", F.month("snapshot_date").alias("period")).agg(
        F.count("*").alias("rows"), F.countDistinct("player_id").alias("players")
    )


@query("E10 L17", """
SELECT * FROM (SELECT season, player_name, count(DISTINCT player_source_id) AS distinct_count, count(*) AS rows, string_agg(DISTINCT player_source_id, ', ' ORDER BY player_source_id) AS examples
FROM history WHERE player_source_id IS NOT NULL GROUP BY season, player_name HAVING count(DISTINCT player_source_id) > 1) ORDER BY distinct_count DESC, rows DESC, season, player_name LIMIT 30""")
def same_name_many_ids(tables):
    rows = tables.history.filter(F.col("player_source_id").isNotNull())
    return aggregates.distinct_lists(rows, ["season", "player_name"], "player_source_id", 30)


@query("E10 L17", """
SELECT * FROM (SELECT player_source_id, count(DISTINCT season || ':' || player_name) AS distinct_count, count(*) AS rows, string_agg(DISTINCT season || ':' || player_name, ', ' ORDER BY season || ':' || player_name) AS examples
FROM history WHERE player_source_id IS NOT NULL GROUP BY player_source_id HAVING count(DISTINCT season || ':' || player_name) > 1) ORDER BY distinct_count DESC, rows DESC, player_source_id LIMIT 30""")
def same_id_many_names(tables):
    rows = tables.history.filter(F.col("player_source_id").isNotNull())
    rows = rows.withColumn("spelling", F.concat_ws(":", "season", "player_name"))
    return aggregates.distinct_lists(rows, ["player_source_id"], "spelling", 30)


# ---- set operations ------------------------------------------------------------------


@query("J2", "SELECT home_team AS team FROM matches UNION SELECT away_team FROM matches UNION SELECT CAST(n_nationkey AS INT) FROM nation")
def known_teams(tables):
    teams = tables.matches.select(F.explode(F.array("home_team", "away_team")).alias("team"))
    return teams.union(tables.read("nation").select(F.col("n_nationkey").cast("int"))).distinct()


@query("J3 L27", "SELECT CAST(n_nationkey AS INT) AS team FROM nation EXCEPT SELECT home_team FROM matches")
def teams_without_home_match(tables):
    return tables.read("nation").select(F.col("n_nationkey").cast("int").alias("team")).subtract(tables.matches.select(F.col("home_team").alias("team")))


@query("J5", "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)")
def exact_duplicates_removed(tables):
    lines = tables.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.unionByName(lines).dropDuplicates()


@query("J6", """
SELECT row_id, player_id, total_points, minutes, xg FROM player_rows UNION ALL SELECT snapshot_id + 1000000000, player_id, NULL, NULL, NULL FROM snapshots WHERE status = 'O'""")
def history_and_current_rows(tables):
    current = tables.snapshots.filter("status = 'O'").select((F.col("snapshot_id") + 1000000000).alias("row_id"), "player_id")
    return tables.player_rows.select("row_id", "player_id", "total_points", "minutes", "xg").unionByName(current, allowMissingColumns=True)


@query("A1 C23", """
SELECT match_id, league, season, match_date, home_team, away_team FROM matches WHERE season = 1997 AND match_date >= DATE '1997-03-01' AND home_goals > away_goals""")
def filtered_scan(tables):
    from pastward.sources.readers import filter_by

    rows = tables.matches.filter("home_goals > away_goals").select("match_id", "league", "season", "match_date", "home_team", "away_team")
    return filter_by(rows, season=1997, match_date=(">=", F.to_date(F.lit("1997-03-01"))), league=None)


@query("I9", "SELECT snapshot_id, run_id, player_id, status, snapshot_date FROM snapshots ORDER BY snapshot_date DESC, snapshot_id DESC LIMIT 100")
def newest_log_rows(tables):
    rows = tables.snapshots.select("snapshot_id", "run_id", "player_id", "status", "snapshot_date")
    return rows.orderBy(F.col("snapshot_date").desc(), F.col("snapshot_id").desc()).limit(100)


