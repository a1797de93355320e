"""Scoreline distribution."""

from pyspark.sql import functions as F

from pastward.operators import match_features, metrics, scorelines, splits
from pastward.operators.quality import rule_violations
from pastward.plans.common import LEAGUE, rounded
from pastward.plans.evaluation import _FOLDS, _draw
from pastward.plans.history import BASE_SQL
from pastward.plans.registry import query
from pastward.sources.tables import materialize

# A column of the match stands for the rating gap; some of it is missing.
_GAP = "CASE WHEN match_id % 7 <> 0 THEN CAST(match_id % 401 - 200 AS DOUBLE) END"
BY = ["fold"]


def folds(tables):
    base = rounded(match_features.base_match_features(tables.matches, tables.team_rows, LEAGUE))
    rows = base.select(
        "match_id", "season", "match_date", "home_team", "away_team", "home_goals", "away_goals", *scorelines.INPUTS
    ).withColumn("gap", F.expr(_GAP))
    # The base rows are stored once; a fold is the number of seasons before a row's own, less one.
    development, _ = splits.development_split(materialize(rows), "season", "match_date")
    ranks = splits.ranked_seasons(development, "season", "match_date").select("season", "season_rank")
    return development.join(ranks, "season")


def validation(rows):
    return rows.filter(F.col("season_rank") > 2).withColumn("fold", F.col("season_rank") - 2).drop("season_rank")


def predictions(tables):
    rows = folds(tables)
    return scorelines.predict(validation(rows), scorelines.fit_walk_forward(rows, "season_rank"), BY, "gap")


def _pooled(cols):
    return f"({' + '.join(f'coalesce(sum({c}), 0)' for c in cols)}) / nullif({' + '.join(f'count({c})' for c in cols)}, 0)"


_FALL = {c: n for n, cols in scorelines._GROUPS.items() for c in cols}
PARAMS = f"""
base AS ({BASE_SQL.strip()}), {_FOLDS},
fr AS (SELECT b.*, {_GAP} AS gap, fold, role FROM base b JOIN f ON f.season = b.season),
p0 AS (SELECT fold, avg(home_goals) AS avg_home_goals, avg(away_goals) AS avg_away_goals,
 {', '.join(f'{_pooled(cols)} AS {n}' for n, cols in scorelines._GROUPS.items())}, {', '.join(f'median({c}) AS med_{c}' for c in scorelines.INPUTS)} FROM fr WHERE role = 'train' GROUP BY fold),
p1 AS (SELECT * REPLACE (coalesce(avg_home_xg, avg_home_goals) AS avg_home_xg, coalesce(avg_away_xg, avg_away_goals) AS avg_away_xg,
 coalesce(avg_xga, (avg_home_goals + avg_away_goals) / 2) AS avg_xga) FROM p0),
par AS (SELECT fold, avg_home_goals, avg_away_goals, avg_home_xg, avg_away_xg, avg_xga, {', '.join(f'coalesce(med_{c}, {_FALL[c]}) AS median_{c}' for c in scorelines.INPUTS)} FROM p1)"""


@query("H1 E15 E16", f"""
WITH {PARAMS} SELECT fold, round(avg_home_goals, 6) AS avg_home_goals, round(avg_away_goals, 6) AS avg_away_goals, round(avg_home_xg, 6) AS avg_home_xg,
 round(avg_away_xg, 6) AS avg_away_xg, round(avg_xga, 6) AS avg_xga, {', '.join(f'round(median_{c}, 6) AS median_{c}' for c in scorelines.INPUTS)} FROM par""")
def scoreline_parameters(tables):
    return rounded(scorelines.fit_walk_forward(folds(tables), "season_rank"))


def _base(cols):
    return "(" + " + ".join(f"coalesce({c}, median_{c})" for c in cols) + ") / 4"


LAMBDAS = PARAMS + f""",
lam AS (SELECT fr.*, least(5.0, greatest(0.05, {_base(scorelines.HOME_INPUTS)} * exp(0.1 * coalesce(gap, 0.0) / 400.0))) AS home_lambda,
 least(5.0, greatest(0.05, {_base(scorelines.AWAY_INPUTS)} * exp(-(0.1 * coalesce(gap, 0.0) / 400.0)))) AS away_lambda
 FROM fr JOIN par ON par.fold = fr.fold WHERE role = 'validation')"""
GRID = LAMBDAS + """,
raw AS (SELECT fold, match_id, i, j, exp(-home_lambda) * pow(home_lambda, i) / factorial(CAST(i AS INT)) AS ph, exp(-away_lambda) * pow(away_lambda, j) / factorial(CAST(j AS INT)) AS pa
 FROM lam, range(7) a(i), range(7) b(j)),
grid AS (SELECT fold, match_id, CAST(i AS INT) AS home_score, CAST(j AS INT) AS away_score, ph * pa / sum(ph * pa) OVER (PARTITION BY fold, match_id) AS p FROM raw)"""


@query("H2", f"WITH {LAMBDAS} SELECT fold, match_id, round(home_lambda, 6) AS home_lambda, round(away_lambda, 6) AS away_lambda FROM lam")
def scoreline_rates(tables):
    rows = folds(tables)
    rows = validation(rows).join(F.broadcast(scorelines.fit_walk_forward(rows, "season_rank")), BY)  # one row per fold
    return rounded(scorelines.with_lambdas(rows, "gap").select("fold", "match_id", "home_lambda", "away_lambda"))


@query("H3 H4", f"WITH {GRID} SELECT fold, match_id, home_score, away_score, round(p, 6) AS p FROM grid")
def scoreline_grid(tables):
    return rounded(scorelines.score_grid(predictions(tables), ["fold", "match_id"]))


OUTCOMES = GRID + """,
out AS (SELECT fold, match_id, sum(p) FILTER (home_score > away_score) AS p_home, sum(p) FILTER (home_score = away_score) AS p_draw,
 sum(p) FILTER (home_score < away_score) AS p_away FROM grid GROUP BY fold, match_id),
best AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY fold, match_id ORDER BY round(p, 9) DESC, home_score * 7 + away_score DESC) <= 5),
pr AS (SELECT l.fold, l.match_id, l.season, l.home_goals, l.away_goals, l.result, home_lambda, away_lambda, p_home, p_draw, p_away,
 CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS predicted_result,
 b.home_score AS predicted_home_goals, b.away_score AS predicted_away_goals
 FROM lam l JOIN out o ON o.fold = l.fold AND o.match_id = l.match_id
 JOIN (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY fold, match_id ORDER BY round(p, 9) DESC, home_score * 7 + away_score DESC) = 1) b
  ON b.fold = l.fold AND b.match_id = l.match_id)"""


@query("H5 H7", f"""
WITH {OUTCOMES} SELECT fold, match_id, season, home_goals, away_goals, result, round(home_lambda, 6) AS home_lambda, round(away_lambda, 6) AS away_lambda,
 round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, predicted_result, predicted_home_goals, predicted_away_goals FROM pr""")
def scoreline_predictions(tables):
    return rounded(predictions(tables).select(
        "fold", "match_id", "season", "home_goals", "away_goals", "result", "home_lambda", "away_lambda", "p_home", "p_draw", "p_away",
        "predicted_result", "predicted_home_goals", "predicted_away_goals",
    ))


@query("H6", f"""
WITH {OUTCOMES} SELECT fold, match_id, CAST(row_number() OVER (PARTITION BY fold, match_id ORDER BY round(p, 9) DESC, home_score * 7 + away_score DESC) AS INT) AS place,
 home_score, away_score, round(p, 9) AS p FROM best""")
def top_scorelines(tables):
    # Written once: exploding a computed array would compute it again for the filter on its size.
    best = materialize(predictions(tables).select("fold", "match_id", "top_scorelines"))
    rows = best.select("fold", "match_id", F.posexplode("top_scorelines").alias("at", "s"))
    return rows.select("fold", "match_id", (F.col("at") + 1).alias("place"), "s.*")


@query("H8", f"""
WITH {OUTCOMES} SELECT fold, count(*) AS rows, round(avg(abs(home_goals - predicted_home_goals)), 6) AS home_goals_mae,
 round(avg(abs(away_goals - predicted_away_goals)), 6) AS away_goals_mae,
 round(avg(abs(home_goals + away_goals - predicted_home_goals - predicted_away_goals)), 6) AS total_goals_mae,
 round(avg(CAST(home_goals = predicted_home_goals AND away_goals = predicted_away_goals AS INT)), 6) AS exact_score_accuracy FROM pr GROUP BY fold""")
def scoreline_goal_scores(tables):
    return rounded(scorelines.goal_scores(predictions(tables), BY))


_HIT = "CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END"
_P, _R, _F1 = _draw("predicted_result", "result")


@query("H8 K25", f"""
WITH {OUTCOMES} SELECT fold, count(*) AS rows, round(avg(CAST(predicted_result = result AS INT)), 6) AS accuracy, round(avg(-ln(greatest({_HIT}, 1e-15))), 6) AS log_loss,
 round(avg(pow(p_home - CAST(result = 'H' AS INT), 2) + pow(p_draw - CAST(result = 'D' AS INT), 2) + pow(p_away - CAST(result = 'A' AS INT), 2)), 6) AS brier_score,
 round({_R}, 6) AS draw_recall, round({_P}, 6) AS draw_precision, round({_F1}, 6) AS draw_f1 FROM pr GROUP BY fold""")
def scoreline_class_scores(tables):
    out = metrics.evaluate(predictions(tables), "result", BY)
    return rounded(out.select("fold", "rows", *metrics.METRICS))


@query("H9", f"""
WITH {OUTCOMES} SELECT fold, round(avg(p_draw), 6) AS mean_draw_proba, round(max(p_draw), 6) AS max_draw_proba,
 count(*) FILTER (p_draw > p_home AND p_draw >= p_away) AS draw_highest_count, count(*) FILTER (p_draw >= 0.25) AS draw_proba_ge_025_count,
 count(*) FILTER (p_draw >= 0.30) AS draw_proba_ge_030_count, round(avg(CAST(result = 'D' AS INT)), 6) AS actual_draw_rate, round(median(p_draw), 6) AS median_draw_proba
FROM pr GROUP BY fold""")
def draw_probability_diagnostics(tables):
    rows = predictions(tables).select("fold", "p_home", "p_draw", "p_away", "result")
    return rounded(scorelines.draw_diagnostics(materialize(rows), BY))


@query("H10", f"""
WITH {OUTCOMES}, cells AS (SELECT fold, match_id, sum(p) AS total FROM grid GROUP BY fold, match_id)
SELECT 'home_lambda_in_bounds' AS rule, count(*) FILTER (home_lambda < 0.05 OR home_lambda > 5) AS violations FROM lam
UNION ALL SELECT 'away_lambda_in_bounds', count(*) FILTER (away_lambda < 0.05 OR away_lambda > 5) FROM lam
UNION ALL SELECT 'grid_sums_to_one', count(*) FILTER (abs(total - 1) > 1e-9) FROM cells
UNION ALL SELECT 'outcomes_in_unit_interval', count(*) FILTER (least(p_home, p_draw, p_away) < -1e-9 OR greatest(p_home, p_draw, p_away) > 1 + 1e-9) FROM out
UNION ALL SELECT 'outcomes_sum_to_one', count(*) FILTER (abs(p_home + p_draw + p_away - 1) > 1e-9) FROM out""")
def scoreline_sanity(tables):
    return rule_violations(predictions(tables), scorelines.sanity_rules())
