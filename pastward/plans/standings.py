"""League tables, pressure and ratings."""

import uuid

from pyspark.sql import functions as F

from pastward.operators import match_features, ratings, standings
from pastward.plans.common import LEAGUE, SEASON, rounded
from pastward.plans.history import _STATE_SQL
from pastward.plans.registry import query
from pastward.session import ensure_checkpoint_dir

TABLE_SQL = """
WITH cur AS (SELECT DISTINCT league, season, match_date FROM team_rows),
teams AS (SELECT DISTINCT league, season, team FROM team_rows),
day AS (SELECT league, season, team, match_date, count(*) AS games, count(*) FILTER (goals_for > goals_against) AS w,
  count(*) FILTER (goals_for = goals_against) AS d, count(*) FILTER (goals_for < goals_against) AS l, sum(goals_for) AS gf, sum(goals_against) AS ga
 FROM team_rows GROUP BY league, season, team, match_date),
agg AS (SELECT c.league, c.season, c.match_date, t.team, CAST(coalesce(sum(p.games) OVER before, 0) AS BIGINT) AS games, CAST(coalesce(sum(p.w) OVER before, 0) AS BIGINT) AS w, CAST(coalesce(sum(p.d) OVER before, 0) AS BIGINT) AS d, CAST(coalesce(sum(p.l) OVER before, 0) AS BIGINT) AS l, CAST(coalesce(sum(p.gf) OVER before, 0) AS BIGINT) AS gf, CAST(coalesce(sum(p.ga) OVER before, 0) AS BIGINT) AS ga
 FROM cur c JOIN teams t ON t.league = c.league AND t.season = c.season
 LEFT JOIN day p ON p.league = t.league AND p.season = t.season AND p.team = t.team AND p.match_date = c.match_date
 WINDOW before AS (PARTITION BY t.league, t.season, t.team ORDER BY c.match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, 3 * w + d AS pts, row_number() OVER (PARTITION BY league, season, match_date
  ORDER BY 3 * w + d DESC, gf - ga DESC, gf DESC, team) AS rk FROM agg),
g AS (SELECT *, max(pts) FILTER (rk = 1) OVER d AS p1, max(pts) FILTER (rk = 4) OVER d AS p4,
  max(pts) FILTER (rk = 6) OVER d AS p6, max(pts) FILTER (rk = 18) OVER d AS p18
 FROM r WINDOW d AS (PARTITION BY league, season, match_date)),
tab AS (SELECT league, season, match_date, team, games AS games_played_before, w AS wins_before, d AS draws_before,
  l AS losses_before, pts AS points_before, CAST(gf AS BIGINT) AS goals_for_before, CAST(ga AS BIGINT) AS goals_against_before,
  CAST(gf - ga AS BIGINT) AS goal_diff_before, round(pts / nullif(games, 0), 6) AS ppg_before,
  CAST(rk AS INT) AS rank_before, p1 - pts AS points_to_1st_before, p4 - pts AS points_to_4th_before,
  p6 - pts AS points_to_6th_before, pts - p18 AS points_above_18th_before FROM g)"""

_BEFORE = (
    "games_played_before wins_before draws_before losses_before points_before goals_for_before goals_against_before "
    "goal_diff_before ppg_before rank_before points_to_1st_before points_to_4th_before points_to_6th_before "
    "points_above_18th_before"
).split()


@query("G6 G7", TABLE_SQL + f"""
SELECT r.match_id, r.league, r.season, r.match_date, r.team, r.opponent, r.venue, {', '.join(_BEFORE)}
FROM team_rows r JOIN tab t ON t.league = r.league AND t.season = r.season AND t.match_date = r.match_date AND t.team = r.team""")
def standings_before_match(tables):
    return rounded(standings.standings_before(tables.team_rows, SEASON))


def _near(gap):
    return (
        f"CASE WHEN games_played_before >= 8 THEN least(1.0, greatest(0.0, (games_played_before - 8) / 22.0)) * "
        f"CASE WHEN {gap} IS NOT NULL THEN greatest(0.0, (6 - {gap}) / 6.0) END END"
    )


_PRESSURE = {
    "title_pressure": _near("points_to_1st_before"),
    "top4_pressure": _near("abs(points_to_4th_before)"),
    "top6_pressure": _near("abs(points_to_6th_before)"),
    "relegation_pressure": _near("abs(points_above_18th_before)"),
}
_PRESSURE_CTE = TABLE_SQL + f""",
pr0 AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _PRESSURE.items())} FROM tab),
pr AS MATERIALIZED (SELECT *, greatest(title_pressure, top4_pressure, top6_pressure, relegation_pressure) AS pressure_index FROM pr0)"""


@query("G8", _PRESSURE_CTE + """
SELECT league, season, match_date, team, rank_before, round(title_pressure, 6) AS title_pressure,
 round(top4_pressure, 6) AS top4_pressure, round(top6_pressure, 6) AS top6_pressure,
 round(relegation_pressure, 6) AS relegation_pressure, round(pressure_index, 6) AS pressure_index FROM pr""")
def pressure_by_date(tables):
    out = standings.pressure(standings.tables_by_date(tables.team_rows, SEASON))
    return rounded(out.select("league", "season", "match_date", "team", "rank_before", *_PRESSURE, "pressure_index"))


_SIDE = ["games_played", "points", "ppg", "rank", "goal_diff", "title_pressure", "top4_pressure", "top6_pressure",
         "relegation_pressure", "pressure_index"]


def _side_col(c):
    return c if "pressure" in c else f"{c}_before"


@query("G9 C13", _PRESSURE_CTE + f"""
SELECT m.match_id, m.league, m.season, m.match_date, m.home_team, m.away_team,
 {', '.join(f"{'round(' if _side_col(c) == c else ''}{t}.{_side_col(c)}{', 6)' if _side_col(c) == c else ''} AS {s}_{c}_before" for c in _SIDE for s, t in (('home', 'h'), ('away', 'a')))},
 h.rank_before - a.rank_before AS rank_diff_before, h.points_before - a.points_before AS points_diff_before,
 round(h.points_before / nullif(h.games_played_before, 0) - a.points_before / nullif(a.games_played_before, 0), 6) + 0.0 AS ppg_diff_before,
 h.goal_diff_before - a.goal_diff_before AS goal_diff_table_diff_before,
 round(greatest(h.pressure_index, a.pressure_index), 6) AS match_pressure_index_before,
 round(h.pressure_index - a.pressure_index, 6) + 0.0 AS pressure_diff_before,
 round((h.games_played_before + a.games_played_before) / 2 / 38, 6) AS season_progress_before
FROM matches m JOIN pr h ON h.league = m.league AND h.season = m.season AND h.match_date = m.match_date AND h.team = m.home_team
JOIN pr a ON a.league = m.league AND a.season = m.season AND a.match_date = m.match_date AND a.team = m.away_team""")
def pressure_features(tables):
    return rounded(standings.pressure_features(tables.matches, tables.team_rows, SEASON))


STARTS_SQL = """
order_ AS (SELECT league, season, row_number() OVER (PARTITION BY league ORDER BY min(event_time), season) AS season_index
 FROM matches GROUP BY league, season),
in_season AS (SELECT DISTINCT r.league, r.season, r.team, o.season_index FROM team_rows r JOIN order_ o USING (league, season)),
starts AS (SELECT s.league, s.season, s.team, CAST(s.season_index AS INT) AS season_index,
  CASE WHEN s.season_index = 1 THEN 'initial' WHEN p.team IS NOT NULL THEN 'carried' ELSE 'promoted_or_returning' END AS initialization
 FROM in_season s LEFT JOIN in_season p ON p.league = s.league AND p.team = s.team AND p.season_index = s.season_index - 1)"""


@query("G3", f"WITH {STARTS_SQL} SELECT * FROM starts")
def season_initialization(tables):
    return ratings.season_starts(tables.matches, "league", "season", "event_time")


@query("G3 G5", f"""
WITH rows_g AS (SELECT * FROM team_rows WHERE match_id IN (SELECT match_id FROM division)),
{STARTS_SQL.replace('FROM matches ', 'FROM division ').replace('team_rows', 'rows_g')}
SELECT league, season, initialization, count(*) AS teams FROM starts GROUP BY league, season, initialization""")
def initialization_counts(tables):
    starts = ratings.season_starts(tables.division, "league", "season", "event_time")
    return starts.groupBy("league", "season", "initialization").agg(F.count("*").alias("teams"))


# Fold of the ratings, one match per league and step; the state is a list with one rating per team.
def elo_cte(matches="matches", rows="team_rows", extra=""):
    starts = STARTS_SQL.replace("FROM matches ", f"FROM {matches} ").replace("FROM team_rows ", f"FROM {rows} ")
    return f"""WITH RECURSIVE {extra}{starts},
firsts AS (SELECT match_id, team, row_number() OVER (PARTITION BY league, season, team ORDER BY event_time, match_id) = 1 AS is_first FROM {rows}),
seq AS MATERIALIZED (SELECT m.*, sh.initialization AS home_initialization, sa.initialization AS away_initialization,
  row_number() OVER (PARTITION BY m.league ORDER BY sh.season_index, m.event_time, m.match_id) AS n,
  CASE WHEN fh.is_first THEN CASE sh.initialization WHEN 'initial' THEN 1500.0 WHEN 'promoted_or_returning' THEN 1400.0 END END AS hset,
  CASE WHEN fa.is_first THEN CASE sa.initialization WHEN 'initial' THEN 1500.0 WHEN 'promoted_or_returning' THEN 1400.0 END END AS aset,
  CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END AS score
 FROM {matches} m JOIN starts sh ON sh.league = m.league AND sh.season = m.season AND sh.team = m.home_team
 JOIN starts sa ON sa.league = m.league AND sa.season = m.season AND sa.team = m.away_team
 JOIN firsts fh ON fh.match_id = m.match_id AND fh.team = m.home_team
 JOIN firsts fa ON fa.match_id = m.match_id AND fa.team = m.away_team),
fold AS (
 SELECT DISTINCT CAST(0 AS BIGINT) AS n, league, CAST(NULL AS BIGINT) AS match_id, CAST(list_transform(range(20), lambda i: 0.0) AS DOUBLE[]) AS r,
  CAST(NULL AS DOUBLE) AS hb, CAST(NULL AS DOUBLE) AS ab FROM seq
 UNION ALL
 SELECT n, league, match_id,
  CAST(list_transform(r, lambda x, i: CASE WHEN i - 1 = home THEN hb + 20.0 * (score - e) WHEN i - 1 = away THEN ab + 20.0 * ((1.0 - score) - (1 - e)) ELSE x END) AS DOUBLE[]), hb, ab
 FROM (SELECT *, 1 / (1 + pow(10.0, (ab - (hb + 50.0)) / 400.0)) AS e FROM (
  SELECT s.n, f.league, s.match_id, f.r, s.home_team AS home, s.away_team AS away, CAST(s.score AS DOUBLE) AS score,
   CAST(coalesce(s.hset, f.r[s.home_team + 1]) AS DOUBLE) AS hb, CAST(coalesce(s.aset, f.r[s.away_team + 1]) AS DOUBLE) AS ab
  FROM fold f JOIN seq s ON s.league = f.league AND s.n = f.n + 1))),
elo AS (SELECT s.*, hb AS home_elo_before, ab AS away_elo_before, hb - ab AS elo_diff_before, (hb + 50.0) - ab AS elo_diff_home_adjusted,
  1 / (1 + pow(10.0, (ab - (hb + 50.0)) / 400.0)) AS expected_home_score, CAST(score AS DOUBLE) AS actual_home_score
 FROM fold f JOIN seq s ON s.match_id = f.match_id),
elo_full AS (SELECT *, hb_delta + home_elo_before AS home_elo_after, ab_delta + away_elo_before AS away_elo_after FROM (
 SELECT *, 20.0 * (actual_home_score - expected_home_score) AS hb_delta,
  20.0 * ((1 - actual_home_score) - (1 - expected_home_score)) AS ab_delta FROM elo))"""


_ELO_SELECT = """
SELECT match_id, league, season, match_date, event_time, home_team, away_team, home_goals, away_goals,
 CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result,
 round(home_elo_before, 4) AS home_elo_before, round(away_elo_before, 4) AS away_elo_before,
 round(elo_diff_before, 4) + 0.0 AS elo_diff_before, round(elo_diff_home_adjusted, 4) + 0.0 AS elo_diff_home_adjusted,
 round(expected_home_score, 4) AS expected_home_score, round(1 - expected_home_score, 4) AS expected_away_score,
 actual_home_score, 1 - actual_home_score AS actual_away_score, home_initialization, away_initialization,
 round(hb_delta, 4) + 0.0 AS home_elo_delta, round(ab_delta, 4) + 0.0 AS away_elo_delta,
 round(home_elo_after, 4) AS home_elo_after, round(away_elo_after, 4) AS away_elo_after FROM elo_full"""
DIVISION_ROWS = "rows_g AS (SELECT * FROM team_rows WHERE match_id IN (SELECT match_id FROM division)),\n"


@query("G1 G2", elo_cte() + _ELO_SELECT)
def elo_ratings(tables):
    return rounded(ratings.elo(tables.matches), 4)


@query("G2 G3", elo_cte("division", "rows_g", DIVISION_ROWS) + _ELO_SELECT)
def elo_ratings_with_returning_teams(tables):
    return rounded(ratings.elo(tables.division), 4)


CURRENT_CTE = """,
sides AS (SELECT league, match_id, match_date, event_time, home_team AS team, home_elo_after AS rating FROM elo_full
 UNION ALL SELECT league, match_id, match_date, event_time, away_team, away_elo_after FROM elo_full),
current_elo AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY league, team ORDER BY event_time DESC, match_id DESC) = 1)"""


@query("G4", elo_cte() + CURRENT_CTE + """
SELECT league, team, match_id, match_date, event_time, round(rating, 4) AS rating FROM current_elo""")
def elo_current(tables):
    return rounded(ratings.current_ratings(ratings.elo(tables.matches), LEAGUE), 4)


def _in_two_steps(matches):
    """Ratings of the later half of all seasons, by appending them to the stored state of the earlier half; and where that state is."""
    path = f"{ensure_checkpoint_dir(matches.sparkSession).rstrip('/')}/ratings/{uuid.uuid4().hex}"
    half = matches.agg(F.floor((F.min("season") + F.max("season")) / 2).alias("half"))  # one row
    split = matches.join(F.broadcast(half))
    ratings.replay_seasons(split.filter("season <= half").drop("half"), path)
    return ratings.replay_seasons(split.filter("season > half").drop("half"), path), path


_HALF = " WHERE season > (SELECT (min(season) + max(season)) // 2 FROM division)"


@query("G2 G3", elo_cte("division", "rows_g", DIVISION_ROWS) + _ELO_SELECT + _HALF)
def elo_of_appended_seasons(tables):
    return rounded(_in_two_steps(tables.division)[0], 4)


@query("G4", elo_cte("division", "rows_g", DIVISION_ROWS) + """,
sides AS (SELECT league, season, season_index, match_id, match_date, event_time, team, rating FROM (
  SELECT *, home_team AS team, home_elo_after AS rating FROM elo_full UNION ALL SELECT *, away_team, away_elo_after FROM elo_full) JOIN order_ USING (league, season))
SELECT league, team, round(rating, 4) AS rating, season, CAST(season_index AS INT) AS season_index, match_id, match_date, event_time,
 CAST(max(season_index) OVER (PARTITION BY league) AS INT) AS league_seasons,
 (SELECT max(s) FROM (SELECT o.league, min(d.event_time) AS s FROM division d JOIN order_ o USING (league, season) GROUP BY o.league, season) b WHERE b.league = sides.league) AS league_start
FROM sides QUALIFY row_number() OVER (PARTITION BY league, team ORDER BY season_index DESC, event_time DESC, match_id DESC) = 1""")
def stored_rating_state(tables):
    spark = tables.division.sparkSession
    return rounded(ratings.load_state(spark, _in_two_steps(tables.division)[1]), 4)


@query("I1 E23 E12", elo_cte() + CURRENT_CTE + """
SELECT league, team, round(rating, 4) AS rating FROM current_elo ORDER BY rating DESC, league, team LIMIT 10""")
def top_rated_teams(tables):
    current = ratings.current_ratings(ratings.elo(tables.matches), LEAGUE)
    return rounded(current.select("league", "team", "rating").orderBy(F.col("rating").desc(), "league", "team").limit(10), 4)


@query("E12 E23", elo_cte() + """
SELECT league, season, count(*) AS matches, min(match_date) AS first_date, max(match_date) AS last_date,
 round(min(least(home_elo_before, away_elo_before)), 4) AS rating_min, round(max(greatest(home_elo_before, away_elo_before)), 4) AS rating_max,
 round((sum(home_elo_before) + sum(away_elo_before)) / (2 * count(*)), 4) AS rating_mean
FROM elo_full GROUP BY league, season""")
def elo_season_summary(tables):
    rows = ratings.elo(tables.matches)
    out = rows.groupBy("league", "season").agg(
        F.count("*").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
        F.min(F.least("home_elo_before", "away_elo_before")).alias("rating_min"),
        F.max(F.greatest("home_elo_before", "away_elo_before")).alias("rating_max"),
        ((F.sum("home_elo_before") + F.sum("away_elo_before")) / (2 * F.count("*"))).alias("rating_mean"),
    )
    return rounded(out, 4)


# Upcoming fixtures: the matches on the last date of each league stand for the schedule.
_STATE_CTE = _STATE_SQL.strip().removeprefix("WITH ")


def _names(side):
    cols = [
        "overall_matches_last5", "overall_matches_last10", "points_overall_last5", "points_overall_last10",
        "goal_diff_overall_last5", "xg_overall_last5", "xga_overall_last5",
    ]
    named = [(c, f"{side}_{c}") for c in cols]
    venue = [f"{side}_{side}_matches_last5"] + [
        f"{side}_{c}_{side}_last5" for c in ("goals_scored", "goals_conceded", "clean_sheet_rate", "xg", "xga")
    ]
    return named + [(c, c) for c in venue]


def _state_pick(side, alias):
    return ", ".join(
        f"CASE WHEN {alias}.team IS NULL THEN 0 ELSE {alias}.{c} END AS {n}" for c, n in _names(side)
    )


@query("F14 D12", elo_cte() + CURRENT_CTE + f""",
st AS (WITH {_STATE_CTE}),
fixtures AS (SELECT m.match_id AS fixture_id, m.league, m.match_date, m.home_team, m.away_team FROM matches m
 JOIN (SELECT league, max(match_date) AS d FROM matches GROUP BY league) l ON l.league = m.league AND l.d = m.match_date),
f AS (SELECT x.*, coalesce(ch.rating, 1400.0) AS home_elo_before, coalesce(ca.rating, 1400.0) AS away_elo_before,
 {_state_pick('home', 'sh')}, {_state_pick('away', 'sa')}
FROM fixtures x LEFT JOIN st sh ON sh.league = x.league AND sh.team = x.home_team
LEFT JOIN st sa ON sa.league = x.league AND sa.team = x.away_team
LEFT JOIN current_elo ch ON ch.league = x.league AND ch.team = x.home_team
LEFT JOIN current_elo ca ON ca.league = x.league AND ca.team = x.away_team)
SELECT * REPLACE (round(home_elo_before, 4) AS home_elo_before, round(away_elo_before, 4) AS away_elo_before),
 round(home_elo_before - away_elo_before, 4) + 0.0 AS elo_diff_before,
 round(home_elo_before - away_elo_before + 50.0, 4) + 0.0 AS elo_diff_home_adjusted,
 round(1 / (1 + pow(10.0, -(home_elo_before - away_elo_before + 50.0) / 400.0)), 4) AS expected_home_score,
 round(1 - 1 / (1 + pow(10.0, -(home_elo_before - away_elo_before + 50.0) / 400.0)), 4) AS expected_away_score FROM f""")
def upcoming_features(tables):
    last = tables.matches.groupBy("league").agg(F.max("match_date").alias("match_date"))
    fixtures = tables.matches.join(last, ["league", "match_date"]).select(
        F.col("match_id").alias("fixture_id"), "league", "match_date", "home_team", "away_team"
    )
    state = rounded(match_features.latest_team_state(tables.team_rows, LEAGUE))
    current = ratings.current_ratings(ratings.elo(tables.matches), LEAGUE)
    out = match_features.upcoming_features(fixtures, state, current, LEAGUE)
    ratings_cols = {c for c in out.columns if "elo" in c or "expected" in c}
    return out.select(*[F.round(c, 4).alias(c) if c in ratings_cols else F.col(c) for c in out.columns])
