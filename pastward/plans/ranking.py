"""Ranking metrics of player predictions, and baselines."""

from pyspark.sql import functions as F

from pastward.operators import metrics, periods, ranking
from pastward.plans.common import rounded
from pastward.plans.evaluation import _MODELS_SQL, _delta_sql, fold_results
from pastward.plans.players import _COLLAPSED, _KW, _PRIOR_COLS, _PRIOR_WINDOWS, collapsed
from pastward.plans.registry import query

PERIOD = ["season", "gameweek"]

# The last-5 mean with the overall mean where there is no history.
BASE_SQL = f"""
WITH {_COLLAPSED}, f AS (SELECT player_id, season, gameweek, row_id, total_points, {_PRIOR_COLS} FROM c {_PRIOR_WINDOWS}),
x AS (SELECT player_id, season, gameweek, row_id, total_points AS target, round(avg(total_points) OVER (), 6) AS mean_baseline,
 round(coalesce(prior_points_last5, avg(total_points) OVER ()), 6) + 0.0 AS last5, round(coalesce(prior_points_last3, avg(total_points) OVER ()), 6) + 0.0 AS last3 FROM f)"""


def predictions(tables):
    rows = periods.prior_only_features(collapsed(tables), "player_id", "season", "gameweek", "row_id", **_KW)
    rows = rounded(rows).select("player_id", *PERIOD, "row_id", F.col("total_points").alias("target"), "prior_points_last5", "prior_points_last3")
    mean = collapsed(tables).agg(F.avg("total_points").alias("mean_baseline"))  # one row
    rows = rows.join(F.broadcast(mean))
    return rounded(rows.select(
        "player_id", *PERIOD, "row_id", "target", "mean_baseline",
        F.coalesce("prior_points_last5", "mean_baseline").alias("last5"), F.coalesce("prior_points_last3", "mean_baseline").alias("last3"),
    ))


@query("K9", BASE_SQL + " SELECT * FROM x")
def average_baselines(tables):
    return predictions(tables)


def _reg(p):
    return (f"round(avg(abs(target - {p})), 6) AS mae, round(sqrt(avg(pow(target - {p}, 2))), 6) AS rmse, "
            f"round(1 - sum(pow(target - {p}, 2)) / nullif(regr_syy(target, {p}), 0), 6) + 0.0 AS r2")


@query("K40", BASE_SQL + f" SELECT season, count(*) AS rows, {_reg('last5')} FROM x GROUP BY season")
def regression_scores(tables):
    return rounded(metrics.regression_scores(predictions(tables), "target", "last5", ["season"]))


def ndcg_sql(p, k, name="nd"):
    return f"""{name} AS (SELECT season, gameweek, CASE WHEN sum(gain * ideal_d) > 0 THEN sum(gain * d) / sum(gain * ideal_d) ELSE 1 END AS ndcg FROM (
 SELECT season, gameweek, gain, avg(d0) OVER (PARTITION BY season, gameweek, {p}) AS d, avg(i0) OVER (PARTITION BY season, gameweek, gain) AS ideal_d FROM (
 SELECT *, CASE WHEN rn <= {k} THEN 1 / log2(rn + 1) ELSE 0 END AS d0, CASE WHEN rt <= {k} THEN 1 / log2(rt + 1) ELSE 0 END AS i0 FROM (
 SELECT *, target - min(target) OVER (PARTITION BY season, gameweek) AS gain, row_number() OVER (PARTITION BY season, gameweek ORDER BY {p} DESC) AS rn,
 row_number() OVER (PARTITION BY season, gameweek ORDER BY target DESC) AS rt FROM x))) GROUP BY season, gameweek)"""


def capture_sql(p, k, name="cp"):
    return f"""{name} AS (SELECT season, gameweek, sum(target) FILTER (rn <= {k}) / sum(target) FILTER (rt <= {k}) AS captured FROM (
 SELECT *, row_number() OVER (PARTITION BY season, gameweek ORDER BY {p} DESC, row_id) AS rn,
 row_number() OVER (PARTITION BY season, gameweek ORDER BY target DESC, row_id) AS rt FROM x) GROUP BY season, gameweek HAVING sum(target) FILTER (rt <= {k}) > 0)"""


@query("K41", f"{BASE_SQL}, {ndcg_sql('last5', 10)} SELECT season, gameweek, round(ndcg, 6) AS ndcg FROM nd")
def ndcg_at_10(tables):
    return rounded(ranking.ndcg(predictions(tables), PERIOD, "target", "last5", 10))


@query("K42 I2", f"{BASE_SQL}, {capture_sql('last5', 10)} SELECT season, gameweek, round(captured, 6) AS captured FROM cp")
def top10_points_captured(tables):
    return rounded(ranking.top_capture(predictions(tables), PERIOD, "target", "last5", "row_id", 10))


@query("I2", BASE_SQL + """ SELECT season, gameweek, player_id, last5, CAST(row_number() OVER w AS INT) AS rank FROM x
WINDOW w AS (PARTITION BY season, gameweek ORDER BY last5 DESC, row_id) QUALIFY row_number() OVER w <= 3""")
def top_players_per_period(tables):
    rows = ranking.top_k(predictions(tables), PERIOD, [F.col("last5").desc(), F.col("row_id")], 3)
    return rows.select(*PERIOD, "player_id", "last5", "rank")


def report_sql(p):
    parts = ", ".join([ndcg_sql(p, k, f"nd{k}") for k in (10, 25, 50)] + [capture_sql(p, k, f"cp{k}") for k in (10, 25, 50)])
    rk = f"""rk AS (SELECT target, {p} AS pr, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2 AS rt,
 rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2 AS rp FROM x)"""
    rows = [
        ("mae", f"SELECT avg(abs(target - {p})) FROM x"), ("rmse", f"SELECT sqrt(avg(pow(target - {p}, 2))) FROM x"),
        ("spearman", "SELECT CASE WHEN min(target) = max(target) OR min(pr) = max(pr) THEN 0 ELSE corr(rt, rp) END FROM rk"),
        *[(f"ndcg_at_{k}", f"SELECT avg(ndcg) FROM nd{k}") for k in (10, 25, 50)],
        *[(f"top{k}_points_captured", f"SELECT avg(captured) FROM cp{k}") for k in (10, 25, 50)],
        ("prediction_mean", f"SELECT avg({p}) FROM x"), ("prediction_std", f"SELECT stddev_pop({p}) FROM x"),
        ("actual_mean", "SELECT avg(target) FROM x"), ("actual_std", "SELECT stddev_samp(target) FROM x"),
        ("validation_rows", "SELECT count(*) FROM x"), ("validation_players", "SELECT count(DISTINCT player_id) FROM x"),
    ]
    return f"{parts}, {rk} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(CAST(({q}) AS DOUBLE), 5) + 0.0 AS value" for m, q in rows
    )


@query("K43 E18", f"{BASE_SQL}, {report_sql('last5')}")
def ranking_report(tables):
    from pastward.sources.tables import materialize

    rows = materialize(predictions(tables))
    return rounded(ranking.ranking_report(rows, PERIOD, "target", "last5", "row_id", "player_id"), 5)


_MODELS = ("mean_baseline", "last5", "last3")


@query("K44", f"{BASE_SQL}, " + ", ".join(ndcg_sql(m, 25, f"n_{m}") for m in _MODELS) + ", t AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, round(avg(abs(target - {m})), 6) AS mae, round((SELECT avg(ndcg) FROM n_{m}), 6) AS ndcg_at_25 FROM x" for m in _MODELS
) + ") SELECT * FROM t WHERE mae < (SELECT mae FROM t WHERE model = 'last3') ORDER BY mae, ndcg_at_25 DESC, model LIMIT 1")
def chosen_candidate(tables):
    from pastward.sources.tables import materialize

    rows = materialize(predictions(tables))
    table = None
    for m in _MODELS:
        gain = ranking.ndcg(rows, PERIOD, "target", m, 25).agg(F.avg("ndcg").alias("ndcg_at_25"))
        one = metrics.regression_scores(rows, "target", m).select(F.lit(m).alias("model"), "mae")
        one = one.join(F.broadcast(gain))  # one row each
        table = one if table is None else table.unionByName(one)
    return ranking.choose_candidate(rounded(table), "last3")


@query("K45", f"""
WITH {_MODELS_SQL}, {_delta_sql('blended', 'plain')},
v AS (SELECT fold, accuracy_delta AS holdout, draw_f1_delta AS cv, draw_recall_delta AS r2h, -brier_score_delta AS r2a FROM d)
SELECT fold, CASE WHEN r2h < -0.05 OR r2a < -0.05 THEN 'goal_r2_worse' WHEN holdout >= 0.01 AND cv < -0.03 THEN 'cv_dropped'
 WHEN greatest(holdout, cv) < 0.01 THEN 'no_improvement' ELSE 'keep' END AS decision FROM v""")
def feature_family_decision(tables):
    deltas = metrics.fold_deltas(fold_results(tables), "blended", "plain")
    rows = deltas.select(
        "fold", F.col("accuracy_delta").alias("holdout"), F.col("draw_f1_delta").alias("cv"), F.col("draw_recall_delta").alias("home_r2"),
        (-F.col("brier_score_delta")).alias("away_r2"),
    )
    return rows.select("fold", metrics.family_decision("holdout", "cv", "home_r2", "away_r2").alias("decision"))
