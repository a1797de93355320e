"""Point-in-time features of teams and pairs."""

from pyspark.sql import functions as F

from pastward.functions.scalars import half_up
from pastward.operators import history, match_features, pairs
from pastward.plans.common import LEAGUE, rounded
from pastward.plans.registry import query


def _clean(col):
    return F.when(F.col(col) == 0, 1.0).otherwise(0.0)


def _form(tables, side, other):
    team = f"{side}_team"
    features = {
        f"{side}_form_scored": F.avg(f"{side}_goals"),
        f"{side}_form_conceded": F.avg(f"{other}_goals"),
        f"{side}_clean_sheet_rate": F.avg("_clean"),
    }
    rows = tables.matches.select(
        "match_id", "league", "match_date", team, f"{side}_goals", f"{other}_goals", _clean(f"{other}_goals").alias("_clean")
    )
    out = history.prior_rows(rows, ["league", team], "match_date", ["match_id"], 5, features)
    return out.withColumns({c: half_up(c, 2) for c in features}).drop("_clean")


FORM_COLUMNS = ["form_scored", "form_conceded", "clean_sheet_rate", "xg_last5", "xga_last5"]


def team_form(tables):
    """Both frames of every team row from one pass: goals over the last 5 at its venue, xg over the last 5 anywhere."""
    rows = tables.team_rows.select("match_id", "league", "match_date", "team", "venue", "goals_for", "goals_against", "xg_for", "xg_against")
    anywhere = {"xg_last5": F.avg("xg_for"), "xga_last5": F.avg("xg_against")}
    at_venue = {"form_scored": F.avg("goals_for"), "form_conceded": F.avg("goals_against"), "clean_sheet_rate": F.avg(_clean("goals_against"))}
    out = history.prior_rows_by_kind(rows, ["league", "team"], "match_date", "venue", ["match_id"], 5, anywhere, at_venue)
    return out.select("match_id", "league", "match_date", "team", "venue", *[half_up(c, 2).alias(c) for c in FORM_COLUMNS])


_FORM_SQL = """
SELECT match_id, league, match_date, {s}_team, {s}_goals, {o}_goals,
 CAST(round(CAST(avg({s}_goals) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) AS {s}_form_scored,
 CAST(round(CAST(avg({o}_goals) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) AS {s}_form_conceded,
 CAST(round(CAST(avg(CASE WHEN {o}_goals = 0 THEN 1.0 ELSE 0.0 END) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) AS {s}_clean_sheet_rate
FROM matches
WINDOW w AS (PARTITION BY league, {s}_team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query("F1 C1", _FORM_SQL.format(s="home", o="away"))
def home_form(tables):
    return _form(tables, "home", "away")


@query("F1 C1", _FORM_SQL.format(s="away", o="home"))
def away_form(tables):
    return _form(tables, "away", "home")


# The tactical columns stand on expressions of the team row.
_STYLE = {
    "ppda": "(goals_for + 1) * 1.0 / nullif(goals_against, 0)",
    "ppda_allowed": "(goals_against + 1) * 1.0 / nullif(goals_for, 0)",
    "deep": "CAST(match_id % 13 AS DOUBLE)",
    "deep_allowed": "CAST(match_id % 11 AS DOUBLE)",
    "xg": "xg_for",
    "xga": "xg_against",
    "npxg": "xg_for * 0.5",
    "npxga": "xg_against * 0.5",
    "npxgd": "xg_for * 0.5 - xg_against * 0.5",
    "goals_for": "CAST(goals_for AS DOUBLE)",
    "goals_against": "CAST(goals_against AS DOUBLE)",
    "xpts": "CAST(match_id % 4 AS DOUBLE)",
}
_STYLE_ROWS = ", ".join(f"CAST({e} AS DOUBLE) AS v_{n}" for n, e in _STYLE.items())
_STYLE_AVGS = ",\n".join(
    f"CAST(round(CAST(avg(v_{n}) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) + 0.0 AS {n}_last5" for n in _STYLE
)


@query("F2 F19", f"""
WITH t AS (SELECT match_id, league, match_date, team, opponent, venue, {_STYLE_ROWS} FROM team_rows)
SELECT match_id, league, match_date, team, opponent, venue, count(*) OVER w AS style_matches_last5, {_STYLE_AVGS}
FROM t WINDOW w AS (PARTITION BY league, team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def style_form(tables):
    values = [F.expr(f"CAST({e} AS DOUBLE)").alias(f"v_{n}") for n, e in _STYLE.items()]
    rows = tables.team_rows.select("match_id", "league", "match_date", "team", "opponent", "venue", *values)
    features = {"style_matches_last5": F.count("*")} | {f"{n}_last5": F.avg(f"v_{n}") for n in _STYLE}
    out = history.prior_rows(rows, ["league", "team"], "match_date", ["match_id"], 5, features)
    return out.withColumns({f"{n}_last5": half_up(f"{n}_last5", 2) for n in _STYLE}).drop(*[f"v_{n}" for n in _STYLE])


_XG_SQL = """
WITH r AS (SELECT match_id, league, team, venue,
  CAST(round(CAST(avg(xg_for) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) AS xg_last5,
  CAST(round(CAST(avg(xg_against) OVER w AS DECIMAL(38,10)), 2) AS DOUBLE) AS xga_last5
 FROM team_rows WINDOW w AS (PARTITION BY league, team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT match_id, league, team AS {s}_team, xg_last5 AS {s}_xg_last5, xga_last5 AS {s}_xga_last5 FROM r WHERE venue = '{v}'"""


def _xg_form(tables, side, venue):
    rows = tables.team_rows.select("match_id", "league", "match_date", "team", "venue", "xg_for", "xg_against")
    features = {f"{side}_xg_last5": F.avg("xg_for"), f"{side}_xga_last5": F.avg("xg_against")}
    rolling = history.prior_rows(rows, ["league", "team"], "match_date", ["match_id"], 5, features)
    return rolling.filter(F.col("venue") == venue).select(
        "match_id", "league", F.col("team").alias(f"{side}_team"), *[half_up(c, 2).alias(c) for c in features]
    )


@query("F5", _XG_SQL.format(s="home", v="H"))
def home_xg_form(tables):
    return _xg_form(tables, "home", "H")


@query("F5", _XG_SQL.format(s="away", v="A"))
def away_xg_form(tables):
    return _xg_form(tables, "away", "A")




_OVERALL = """
SELECT match_id, team, count(*) FILTER (back <= 5) AS n5, count(*) FILTER (back <= 10) AS n10,
 avg(points) FILTER (back <= 5) AS points5, avg(points) FILTER (back <= 10) AS points10,
 avg(goals_for - goals_against) FILTER (back <= 5) AS gd5,
 avg(xg_for) FILTER (back <= 5) AS xg5, avg(xg_against) FILTER (back <= 5) AS xga5
FROM team_past GROUP BY match_id, team"""
_VENUE = """
SELECT match_id, team, count(*) AS n, avg(goals_for) AS gf, avg(goals_against) AS ga,
 avg(CASE WHEN goals_against = 0 THEN 1.0 ELSE 0.0 END) AS cs, avg(xg_for) AS xg, avg(xg_against) AS xga
FROM team_past WHERE past_venue = '{v}' AND venue = '{v}' AND venue_back <= 5 GROUP BY match_id, team"""


def _venue_cols(alias, side):
    names = ("goals_scored:gf", "goals_conceded:ga", "clean_sheet_rate:cs", "xg:xg", "xga:xga")
    cols = [f"CAST(coalesce({alias}.n, 0) AS INT) AS {side}_{side}_matches_last5"]
    for pair in names:
        out, c = pair.split(":")
        cols.append(f"round({alias}.{c}, 6) AS {side}_{out}_{side}_last5")
    return ", ".join(cols)


def _overall_cols(alias, side):
    return (
        f"CAST(coalesce({alias}.n5, 0) AS INT) AS {side}_overall_matches_last5, "
        f"CAST(coalesce({alias}.n10, 0) AS INT) AS {side}_overall_matches_last10, "
        f"round({alias}.points5, 6) AS {side}_points_overall_last5, round({alias}.points10, 6) AS {side}_points_overall_last10, "
        f"round({alias}.gd5, 6) + 0.0 AS {side}_goal_diff_overall_last5, round({alias}.xg5, 6) AS {side}_xg_overall_last5, "
        f"round({alias}.xga5, 6) AS {side}_xga_overall_last5"
    )


BASE_SQL = f"""
WITH o AS ({_OVERALL}), vh AS ({_VENUE.format(v='H')}), va AS ({_VENUE.format(v='A')})
SELECT m.match_id, m.league, m.season, m.match_date, m.event_time, m.home_team, m.away_team, m.home_goals, m.away_goals,
 CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result,
 CAST(home_goals > away_goals AS INT) AS home_win, CAST(home_goals = away_goals AS INT) AS is_draw,
 CAST(home_goals < away_goals AS INT) AS away_win,
 {_overall_cols('ho', 'home')}, {_venue_cols('vh', 'home')}, {_overall_cols('ao', 'away')}, {_venue_cols('va', 'away')}
FROM matches m
LEFT JOIN o ho ON ho.match_id = m.match_id AND ho.team = m.home_team
LEFT JOIN o ao ON ao.match_id = m.match_id AND ao.team = m.away_team
LEFT JOIN vh ON vh.match_id = m.match_id AND vh.team = m.home_team
LEFT JOIN va ON va.match_id = m.match_id AND va.team = m.away_team"""


@query("F3 C2 C3 C4 D8", BASE_SQL)
def base_match_features(tables):
    out = match_features.base_match_features(tables.matches, tables.team_rows, LEAGUE)
    return rounded(out)


_STYLE_PARTS = [
    (f"{part}_last{n}", f"CASE WHEN count(*) FILTER (back <= {n}) >= {n} THEN avg({col}) FILTER (back <= {n}) END")
    for n in (5, 10) for part, col in (("attack_xg", "xg_for"), ("defense_xga", "xg_against"))
]


def _style_diff(n, tail=""):
    ha, ad = f"h.attack_xg_last{n}", f"a.defense_xga_last{n}"
    aa, hd = f"a.attack_xg_last{n}", f"h.defense_xga_last{n}"
    return (
        f"round({ha} - {ad}, 6) + 0.0 AS home_attack_minus_away_defense_last{n}, "
        f"round({aa} - {hd}, 6) + 0.0 AS away_attack_minus_home_defense_last{n}, "
        f"round(({ha} - {ad}) - ({aa} - {hd}), 6) + 0.0 AS style_xg_pressure_diff_last{n}"
    )


@query("F4", f"""
WITH s AS (SELECT match_id, team, {', '.join(f'{e} AS {n}' for n, e in _STYLE_PARTS)} FROM team_past GROUP BY match_id, team)
SELECT m.match_id, m.league, m.event_time, m.home_team, m.away_team,
 {', '.join(f'round(h.{n}, 6) AS home_{n}, round(a.{n}, 6) AS away_{n}' for n, _ in _STYLE_PARTS)},
 {_style_diff(5)}, {_style_diff(10)}
FROM matches m LEFT JOIN s h ON h.match_id = m.match_id AND h.team = m.home_team
LEFT JOIN s a ON a.match_id = m.match_id AND a.team = m.away_team""")
def mature_style_features(tables):
    return rounded(match_features.mature_style_features(tables.matches, tables.team_rows, LEAGUE))


H2H_SQL = """
WITH p AS (SELECT m.match_id, m.match_date, p.match_date AS past_date,
  CASE WHEN p.home_team = m.home_team THEN p.home_goals ELSE p.away_goals END AS hg,
  CASE WHEN p.home_team = m.home_team THEN p.away_goals ELSE p.home_goals END AS ag,
  row_number() OVER (PARTITION BY m.match_id ORDER BY p.event_time DESC, p.match_id DESC) AS back
 FROM matches m JOIN matches p ON p.league = m.league AND p.event_time < m.event_time
  AND least(p.home_team, p.away_team) = least(m.home_team, m.away_team)
  AND greatest(p.home_team, p.away_team) = greatest(m.home_team, m.away_team)),
s AS (SELECT match_id, count(*) AS n, count(*) FILTER (hg > ag) AS hw, count(*) FILTER (hg = ag) AS dr,
  count(*) FILTER (hg < ag) AS aw, avg(hg) AS hg, avg(ag) AS ag,
  avg(CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END) AS hp,
  avg(CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END) AS ap, avg(hg - ag) AS gd,
  max(CASE WHEN back = 1 THEN date_diff('day', past_date, match_date) END) AS days,
  max(CASE WHEN back = 1 THEN p.hg END) AS lhg, max(CASE WHEN back = 1 THEN p.ag END) AS lag
 FROM p GROUP BY match_id)
SELECT m.match_id, coalesce(n, 0) AS h2h_matches_prior, coalesce(hw, 0) AS h2h_home_wins_prior,
 coalesce(dr, 0) AS h2h_draws_prior, coalesce(aw, 0) AS h2h_away_wins_prior,
 round(hg, 6) AS h2h_home_goals_avg_prior, round(ag, 6) AS h2h_away_goals_avg_prior,
 round(hp, 6) AS h2h_home_points_avg_prior, round(ap, 6) AS h2h_away_points_avg_prior,
 round(gd, 6) + 0.0 AS h2h_goal_diff_avg_prior, round(hw / n, 6) AS h2h_home_win_rate_prior,
 round(dr / n, 6) AS h2h_draw_rate_prior, round(aw / n, 6) AS h2h_away_win_rate_prior,
 CAST(days AS INT) AS h2h_last_meeting_days, lhg AS h2h_last_meeting_home_goals, lag AS h2h_last_meeting_away_goals,
 CASE WHEN lhg > lag THEN 'H' WHEN lhg = lag THEN 'D' WHEN lhg < lag THEN 'A' END AS h2h_last_meeting_result
FROM matches m LEFT JOIN s ON s.match_id = m.match_id"""

_H2H_BLOCK = [
    "h2h_home_goals_avg_prior", "h2h_away_goals_avg_prior", "h2h_home_points_avg_prior", "h2h_away_points_avg_prior",
    "h2h_goal_diff_avg_prior", "h2h_home_win_rate_prior", "h2h_draw_rate_prior", "h2h_away_win_rate_prior",
    "h2h_last_meeting_days", "h2h_last_meeting_home_goals", "h2h_last_meeting_away_goals", "h2h_last_meeting_result",
]


@query("F15 D9", H2H_SQL)
def head_to_head_prior(tables):
    return rounded(pairs.pair_history(tables.matches, LEAGUE))


@query("F16", f"""
WITH h AS ({H2H_SQL.strip()})
SELECT match_id, h2h_matches_prior, h2h_home_wins_prior, h2h_draws_prior, h2h_away_wins_prior,
 {', '.join(f'CASE WHEN h2h_matches_prior >= 3 THEN {c} END AS {c}' for c in _H2H_BLOCK)} FROM h""")
def head_to_head_with_evidence(tables):
    return pairs.apply_min_evidence(
        rounded(pairs.pair_history(tables.matches, LEAGUE)), "h2h_matches_prior", 3, _H2H_BLOCK
    )


@query("E24", f"""
WITH h AS ({H2H_SQL.strip()})
SELECT m.league, m.season, count(*) FILTER (h2h_matches_prior = 0) AS none, count(*) FILTER (h2h_matches_prior = 1) AS one,
 count(*) FILTER (h2h_matches_prior = 2) AS two, count(*) FILTER (h2h_matches_prior >= 3) AS three_or_more,
 max(h2h_matches_prior) AS most, round(avg(h2h_matches_prior), 6) AS mean_prior,
 round(count(*) FILTER (h2h_matches_prior >= 3) / count(*), 6) AS usable_share
FROM h JOIN matches m ON m.match_id = h.match_id GROUP BY m.league, m.season""")
def head_to_head_evidence(tables):
    n = F.col("h2h_matches_prior")
    rows = pairs.pair_history(tables.matches, LEAGUE).select("match_id", "h2h_matches_prior")
    out = rows.join(tables.matches.select("match_id", "league", "season"), "match_id").groupBy("league", "season").agg(
        F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"), F.count_if(n == 2).alias("two"),
        F.count_if(n >= 3).alias("three_or_more"), F.max(n).alias("most"), F.avg(n).alias("mean_prior"),
        (F.count_if(n >= 3) / F.count("*")).alias("usable_share"),
    )
    return rounded(out)


_STATE_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY event_time DESC, match_id DESC) AS back,
  row_number() OVER (PARTITION BY league, team, venue ORDER BY event_time DESC, match_id DESC) AS vback,
  CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points FROM team_rows)
SELECT league, team, CAST(count(*) FILTER (back <= 5) AS INT) AS overall_matches_last5,
 CAST(count(*) FILTER (back <= 10) AS INT) AS overall_matches_last10,
 round(avg(points) FILTER (back <= 5), 6) AS points_overall_last5, round(avg(points) FILTER (back <= 10), 6) AS points_overall_last10,
 round(avg(goals_for - goals_against) FILTER (back <= 5), 6) + 0.0 AS goal_diff_overall_last5,
 round(avg(xg_for) FILTER (back <= 5), 6) AS xg_overall_last5, round(avg(xg_against) FILTER (back <= 5), 6) AS xga_overall_last5,
 {', '.join(f'''CAST(count(*) FILTER (venue = '{v}' AND vback <= 5) AS INT) AS {s}_{s}_matches_last5,
 round(avg(goals_for) FILTER (venue = '{v}' AND vback <= 5), 6) AS {s}_goals_scored_{s}_last5,
 round(avg(goals_against) FILTER (venue = '{v}' AND vback <= 5), 6) AS {s}_goals_conceded_{s}_last5,
 round(avg(CASE WHEN goals_against = 0 THEN 1.0 ELSE 0.0 END) FILTER (venue = '{v}' AND vback <= 5), 6) AS {s}_clean_sheet_rate_{s}_last5,
 round(avg(xg_for) FILTER (venue = '{v}' AND vback <= 5), 6) AS {s}_xg_{s}_last5,
 round(avg(xg_against) FILTER (venue = '{v}' AND vback <= 5), 6) AS {s}_xga_{s}_last5''' for v, s in (('H', 'home'), ('A', 'away')))}
FROM r GROUP BY league, team"""


@query("F13", _STATE_SQL)
def latest_team_state(tables):
    return rounded(match_features.latest_team_state(tables.team_rows, LEAGUE))


@query("F17", """
SELECT player_id, run_id, snapshot_id, status, now_cost, snapshot_date FROM snapshots
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY run_id DESC, snapshot_date DESC NULLS LAST, snapshot_id DESC) = 1""")
def latest_snapshot_per_player(tables):
    return history.latest_by(tables.snapshots, ["player_id"], ["run_id", "snapshot_date", "snapshot_id"]).select(
        "player_id", "run_id", "snapshot_id", "status", "now_cost", "snapshot_date"
    )
