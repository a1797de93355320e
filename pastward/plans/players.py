"""Features of players per period."""

from pyspark.sql import functions as F

from pastward.functions.scalars import season_order
from pastward.operators import periods
from pastward.plans.common import rounded
from pastward.plans.registry import query

PLAYER, PERIOD = ["player_id"], ["gameweek"]
_SUMS = {"gw_total_points": "total_points", "gw_minutes": "minutes", "gw_goals": "goals", "gw_xg": "xg"}
_MEANS = {"gw_value": "total_points", "gw_position": "position"}

ROLLUP_SQL = """
rollup_ AS (SELECT player_id, gameweek, sum(CAST(total_points AS DOUBLE)) AS gw_total_points, sum(CAST(minutes AS DOUBLE)) AS gw_minutes,
 sum(CAST(goals AS DOUBLE)) AS gw_goals, round(sum(xg), 6) AS gw_xg, avg(CAST(total_points AS DOUBLE)) AS gw_value,
 avg(CAST(position AS DOUBLE)) AS gw_position FROM player_rows GROUP BY player_id, gameweek)"""


def _rollup(tables):
    out = periods.period_rollup(tables.player_rows, [*PLAYER, *PERIOD], _SUMS, _MEANS)
    return out.withColumn("gw_xg", F.round("gw_xg", 6))


@query("E3", f"""
WITH {ROLLUP_SQL} SELECT player_id, gameweek, round(gw_total_points, 6) AS gw_total_points, round(gw_minutes, 6) AS gw_minutes,
 gw_goals, gw_xg, round(gw_value, 6) AS gw_value, gw_position FROM rollup_""")
def player_period_rollup(tables):
    return rounded(_rollup(tables))


@query("E4", """
SELECT player_id, season, gameweek, min(row_id) AS row_id, CAST(sum(total_points) AS BIGINT) AS total_points,
 CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals, round(sum(xg), 6) AS xg,
 arg_min(team_id, row_id) AS team_id, arg_min(minutes_first, row_id) FILTER (minutes_first IS NOT NULL) AS minutes_first,
 count(row_id) AS row_count
FROM (SELECT *, minutes AS minutes_first FROM player_rows) GROUP BY player_id, season, gameweek""")
def player_period_collapse(tables):
    rows = tables.player_rows.withColumn("minutes_first", F.col("minutes"))
    out = periods.period_collapse(
        rows, ["player_id", "season", "gameweek"], "row_id", ["total_points", "minutes", "goals", "xg"],
        ["team_id", "minutes_first"],
    )
    return rounded(out)


_LAGS = {"points_prev1": "gw_total_points", "minutes_prev1": "gw_minutes", "xg_prev1": "gw_xg", "value_prev1": "gw_value"}


@query("F6", f"""
WITH {ROLLUP_SQL} SELECT player_id, gameweek, {', '.join(f'round(lag({c}) OVER w, 6) AS {n}' for n, c in _LAGS.items())}
FROM rollup_ WINDOW w AS (PARTITION BY player_id ORDER BY gameweek)""")
def player_lags(tables):
    out = periods.lagged(_rollup(tables), PLAYER, PERIOD, _LAGS)
    return rounded(out.select(*PLAYER, *PERIOD, *_LAGS))


_ROLL = {"history_matches_last5": ("count(*)", 5)} | {
    f"{name}_avg_last{n}": (f"avg({col})", n)
    for name, col in (
        ("points", "gw_total_points"), ("minutes", "gw_minutes"), ("xg", "gw_xg"), ("goals", "gw_goals"),
        ("value", "gw_value"), ("position", "gw_position"),
    )
    for n in (3, 5)
}
_ROLL_COLS = ", ".join(
    f"{e} OVER w{n} AS {name}" if name.startswith("history") else f"round({e} OVER w{n}, 6) + 0.0 AS {name}"
    for name, (e, n) in _ROLL.items()
)
_ROLL_WINDOWS = """WINDOW w3 AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
 w5 AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


def _features():
    return {name: (F.expr(e), n) for name, (e, n) in _ROLL.items()}


@query("F7", f"WITH {ROLLUP_SQL} SELECT player_id, gameweek, {_ROLL_COLS} FROM rollup_ {_ROLL_WINDOWS}")
def player_rolling(tables):
    out = periods.rolling(_rollup(tables), PLAYER, PERIOD, _features())
    return rounded(out.select(*PLAYER, *PERIOD, *_ROLL))


_PPF_SQL = f"""
WITH {ROLLUP_SQL},
l AS (SELECT player_id, gameweek, {', '.join(f'round(lag({c}) OVER w0, 6) AS {n}' for n, c in _LAGS.items())}, {_ROLL_COLS}
 FROM rollup_ {_ROLL_WINDOWS}, w0 AS (PARTITION BY player_id ORDER BY gameweek))"""


def _period_features(tables):
    rows = tables.player_rows.select("player_id", "gameweek", "row_id", "kickoff_time", "team_id", "position", F.col("total_points").alias("target"))
    return periods.player_period_features(rows, PLAYER, PERIOD, _LAGS, _features(), _rollup(tables))


@query("F8 D5", _PPF_SQL + f"""
SELECT p.player_id, p.gameweek, p.row_id, p.team_id, p.position, p.total_points AS target, {', '.join(_LAGS)}, {', '.join(_ROLL)}
FROM player_rows p LEFT JOIN l ON l.player_id = p.player_id AND l.gameweek = p.gameweek""")
def player_period_features(tables):
    return rounded(_period_features(tables).drop("kickoff_time"))


@query("L9", _PPF_SQL + f"""
SELECT count(*) AS double_groups, CAST(coalesce(sum(CAST(distinct_values > 1 AS INT)), 0) AS BIGINT) AS leaking_groups FROM (
 SELECT p.player_id, p.gameweek, count(*) AS n, greatest({', '.join(f"count(DISTINCT l.{c}) + max(CAST(l.{c} IS NULL AS INT)) * CAST(count(l.{c}) > 0 AS INT)" for c in [*_LAGS, *_ROLL])}) AS distinct_values
 FROM player_rows p LEFT JOIN l ON l.player_id = p.player_id AND l.gameweek = p.gameweek GROUP BY p.player_id, p.gameweek HAVING count(*) > 1)""")
def same_period_leakage(tables):
    from pastward.operators.quality import constant_within

    return constant_within(rounded(_period_features(tables)), [*PLAYER, *PERIOD], [*_LAGS, *_ROLL])


_STATS = ["goals", "xg"]
# Periods of two seasons: the first half of the month counts as the earlier season.
_COLLAPSED = """
c AS (SELECT player_id, CAST(CASE WHEN gameweek <= 15 THEN 2023 ELSE 2024 END AS INT) AS season, gameweek, min(row_id) AS row_id,
 CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals, round(sum(xg), 6) AS xg
 FROM player_rows GROUP BY player_id, gameweek)"""
_PRIOR_COLS = f"""lag(total_points) OVER w AS prior_points_last1,
 {', '.join(f'round(avg({c}) OVER w{n}, 6) + 0.0 AS prior_{o}_last{n}' for o, c in (('points', 'total_points'), ('minutes', 'minutes')) for n in (3, 5, 10))},
 CAST(sum(CASE WHEN coalesce(minutes, 0) > 0 THEN 1 ELSE 0 END) OVER w5 AS DOUBLE) AS prior_appearances_last5,
 CAST(sum(coalesce(goals, 0)) OVER w5 AS DOUBLE) AS prior_goals_last5, round(sum(coalesce(xg, 0)) OVER w5, 6) AS prior_xg_last5,
 CAST(coalesce(sum(coalesce(minutes, 0)) OVER wall, 0) AS DOUBLE) AS prior_minutes_total,
 CAST(coalesce(sum(CASE WHEN coalesce(minutes, 0) > 0 THEN 1 ELSE 0 END) OVER wall, 0) AS DOUBLE) AS prior_periods_played,
 CAST(coalesce(sum(coalesce(total_points, 0)) OVER wseason, 0) AS DOUBLE) AS prior_points_season,
 CAST(row_number() OVER w - 1 AS INT) AS prior_row_count,
 CASE WHEN row_number() OVER w > 1 THEN first_value(season) OVER wfull END AS history_start_season,
 CASE WHEN row_number() OVER w > 1 THEN first_value(gameweek) OVER wfull END AS history_start_period,
 lag(season) OVER w AS history_end_season, lag(gameweek) OVER w AS history_end_period,
 round(CASE WHEN coalesce(sum(coalesce(minutes, 0)) OVER wall, 0) > 0 THEN sum(coalesce(total_points, 0)) OVER wall * 90.0 / sum(coalesce(minutes, 0)) OVER wall END, 6) + 0.0 AS prior_points_per_90"""
_PRIOR_WINDOWS = "WINDOW w AS (PARTITION BY player_id ORDER BY season, gameweek, row_id), " + ", ".join(
    f"w{n} AS (PARTITION BY player_id ORDER BY season, gameweek, row_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 10)
) + """, wall AS (PARTITION BY player_id ORDER BY season, gameweek, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 wfull AS (PARTITION BY player_id ORDER BY season, gameweek, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 wseason AS (PARTITION BY player_id, season ORDER BY gameweek, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_KW = dict(points="total_points", minutes="minutes", stats=_STATS)


def collapsed(tables):
    rows = tables.player_rows.withColumn("season", F.when(F.col("gameweek") <= 15, 2023).otherwise(2024))
    out = periods.period_collapse(
        rows, ["player_id", "season", "gameweek"], "row_id", ["total_points", "minutes", "goals", "xg"], []
    )
    return rounded(out.drop("row_count"))


@query("F9 F10 F11", f"WITH {_COLLAPSED} SELECT player_id, season, gameweek, row_id, total_points, minutes, goals, xg, {_PRIOR_COLS} FROM c {_PRIOR_WINDOWS}")
def player_prior_features(tables):
    return rounded(periods.prior_only_features(collapsed(tables), "player_id", "season", "gameweek", "row_id", **_KW))


@query("F12 J6", f"""
WITH {_COLLAPSED},
b AS (SELECT * FROM c WHERE (season, gameweek) < (2024, 25)),
t AS (SELECT * FROM b UNION ALL SELECT player_id, 2024, 25, max(row_id) + 1, NULL, NULL, NULL, NULL FROM b GROUP BY player_id),
f AS (SELECT player_id, season, gameweek, {_PRIOR_COLS} FROM t {_PRIOR_WINDOWS})
SELECT * FROM f WHERE season = 2024 AND gameweek = 25""")
def player_features_at_target(tables):
    out = periods.features_at(collapsed(tables), "player_id", "season", "gameweek", "row_id", (2024, 25), **_KW)
    return rounded(out)


@query("C24", f"""
WITH {_PPF_SQL.strip().removeprefix('WITH ')}
SELECT p.row_id, p.player_id, p.gameweek, coalesce(p.team_id, p.position) AS team_id, l.history_matches_last5,
 CAST(p.total_points AS DOUBLE) AS target, l.points_avg_last5
FROM player_rows p JOIN l ON l.player_id = p.player_id AND l.gameweek = p.gameweek WHERE l.history_matches_last5 >= 3""")
def mature_player_rows(tables):
    rows = _period_features(tables).select(
        "row_id", "player_id", "gameweek", F.col("position").alias("stored"), F.col("team_id").alias("now"),
        "history_matches_last5", "target", "points_avg_last5",
    )
    out = periods.mature_rows(rows, "history_matches_last5", 3, "now", "stored", ["target"])
    return rounded(out.drop("now").withColumnRenamed("stored", "team_id"))


@query("E22", """
WITH p AS (SELECT gameweek, bool_and(minutes IS NOT NULL) AS finished, count(*) FILTER (minutes IS NULL) AS open_rows FROM player_rows GROUP BY gameweek)
SELECT min(gameweek) FILTER (NOT finished) AS next_open_period, max(gameweek) FILTER (finished) AS last_completed_period FROM p""")
def open_and_completed_period(tables):
    per = tables.player_rows.groupBy("gameweek").agg(F.bool_and(F.col("minutes").isNotNull()).alias("finished"))
    return per.agg(
        F.min(F.when(~F.col("finished"), F.col("gameweek"))).alias("next_open_period"),
        F.max(F.when(F.col("finished"), F.col("gameweek"))).alias("last_completed_period"),
    )


@query("C12", """
SELECT DISTINCT season, CAST(substr(CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR), 1, 4) AS INT) AS season_order FROM matches""")
def season_order_from_label(tables):
    label = F.concat_ws("-", F.col("season"), F.col("season") + 1)
    return tables.matches.select("season", season_order(label).alias("season_order")).distinct()
