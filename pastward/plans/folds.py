"""Walk-forward models whose folds come from one scan."""

from pyspark.sql import functions as F

from pastward.operators import fold_stats, gram, metrics, periods
from pastward.plans.common import rounded
from pastward.plans.players import _COLLAPSED, _KW, _PRIOR_COLS, _PRIOR_WINDOWS, collapsed
from pastward.plans.registry import query
from pastward.sources.tables import materialize

POINTS = ["prior_points_last3", "prior_points_last5", "prior_minutes_last5", "prior_goals_last5", "prior_xg_last5"]
MIN_TRAIN = 10
_P = len(POINTS)


def player_points(tables):
    """Points of each player and period with prior features, and the place of the period in time (a row per period is ranked)."""
    from pyspark.sql import Window

    rows = rounded(periods.prior_only_features(collapsed(tables), "player_id", "season", "gameweek", "row_id", **_KW))
    rows = materialize(rows.select("player_id", "season", "gameweek", "row_id", F.col("total_points").alias("target"), *POINTS))
    ranks = rows.select("season", "gameweek").distinct().withColumn("period_rank", F.row_number().over(Window.orderBy("season", "gameweek")))
    return rows.join(ranks, ["season", "gameweek"])


def validation(rows):
    """Every row after the first periods, in the fold that it validates."""
    return rows.filter(F.col("period_rank") > MIN_TRAIN).withColumn("fold", F.col("period_rank") - MIN_TRAIN)


_ROWS = f"""
WITH {_COLLAPSED}, pf AS (SELECT player_id, season, gameweek, row_id, total_points AS target, {_PRIOR_COLS} FROM c {_PRIOR_WINDOWS}),
x AS (SELECT *, CAST(dense_rank() OVER (ORDER BY season, gameweek) AS INT) AS period_rank FROM pf),
k AS (SELECT CAST(unnest(range(1, max(period_rank) - {MIN_TRAIN} + 1)) AS INT) AS fold FROM x),
t AS (SELECT k.fold, x.* FROM k JOIN x ON x.period_rank <= k.fold + {MIN_TRAIN - 1})"""
_NAMES = [f"x_{c}" for c in POINTS] + [f"m_{c}" for c in POINTS] + ["one", "y"]
_VALUE = {f"x_{c}": f"coalesce({c}, 0)" for c in POINTS} | {f"m_{c}": f"CAST({c} IS NULL AS INT)" for c in POINTS} | {"one": "1", "y": "target"}


@query("K13 K3", _ROWS + ", g AS (SELECT fold, " + ", ".join(
    f"CAST(sum({_VALUE[a]} * {_VALUE[b]}) AS DOUBLE) AS {a}__{b}" for a, b in gram.gram_names(POINTS)) + " FROM t GROUP BY fold) " + " UNION ALL ".join(
    f"SELECT fold, '{a}' AS \"left\", '{b}' AS \"right\", round({a}__{b} / one__one, 4) + 0.0 AS mean FROM g" for a, b in gram.gram_names(POINTS)))
def fold_gram_entries(tables):
    grams = gram.fold_grams(player_points(tables), "period_rank", POINTS, "target", MIN_TRAIN)
    rows = gram.gram_entries(grams, POINTS).join(F.broadcast(grams.select("fold", "one__one")), "fold")  # one row per fold
    return rounded(rows.select("fold", "left", "right", (F.col("total") / F.col("one__one")).alias("mean")), 4)


@query("K13 K3 E15", _ROWS + " SELECT fold, " + ", ".join(f"round(median({c}), 6) AS median_{c}" for c in POINTS) + " FROM t GROUP BY fold")
def fold_feature_medians(tables):
    return rounded(fold_stats.medians(player_points(tables), "period_rank", POINTS, MIN_TRAIN))


# The same coefficients by elimination on the rows of each fold: filled, centred, penalised.
_FILLED = _ROWS + ", md AS (SELECT fold, " + ", ".join(f"coalesce(median({c}), 0) AS d{i}" for i, c in enumerate(POINTS)) + " FROM t GROUP BY fold)"
_FILLED += ", z AS (SELECT t.fold, target AS y, " + ", ".join(f"coalesce(t.{c}, d{i}) AS z{i}" for i, c in enumerate(POINTS)) + " FROM t JOIN md ON md.fold = t.fold)"
_RIDGE = _FILLED + f""",
a AS (SELECT fold, avg(y) AS my, {', '.join(f'avg(z{i}) AS a{i}' for i in range(_P))} FROM z GROUP BY fold),
e AS (SELECT z.fold, 0 AS step, [{', '.join('[' + ', '.join(
    [f'sum((z{i} - a{i}) * (z{j} - a{j})) + {gram.ALPHA if i == j else 0.0}' for j in range(_P)] + [f'sum((z{i} - a{i}) * (y - my))']) + ']' for i in range(_P))}] AS m
 FROM z JOIN a ON a.fold = z.fold GROUP BY z.fold),
s AS (SELECT fold, step, m FROM e UNION ALL
 SELECT fold, step + 1, list_transform(m, lambda v, i: CASE WHEN i = step + 1 THEN list_transform(v, lambda q: q / m[step + 1][step + 1])
  ELSE list_transform(v, lambda q, j: q - v[step + 1] / m[step + 1][step + 1] * m[step + 1][j]) END) FROM s WHERE step < {_P}),
co AS (SELECT a.fold, my - ({' + '.join(f'a{i} * m[{i + 1}][{_P + 1}]' for i in range(_P))}) AS intercept, {', '.join(f'm[{i + 1}][{_P + 1}] AS b{i}' for i in range(_P))}
 FROM s JOIN a ON a.fold = s.fold WHERE step = {_P})""".replace("WITH ", "", 0)
_RIDGE = _RIDGE.replace("WITH ", "WITH RECURSIVE ", 1)


@query("K13 K3", _RIDGE + f" SELECT fold, round(intercept, 6) AS intercept, {', '.join(f'round(b{i}, 6) + 0.0 AS {c}' for i, c in enumerate(POINTS))}, CAST(0 AS DOUBLE) AS residual FROM co")
def walk_forward_ridge_models(tables):
    models = gram.walk_forward_ridge(player_points(tables), "period_rank", POINTS, "target", MIN_TRAIN)
    return rounded(models.select("fold", "intercept", *POINTS, "residual"))


def points_predictions(tables):
    """Validation rows of every fold with three predictions: the mean of the training rows, the last five periods, ridge."""
    rows = materialize(player_points(tables))
    mean = fold_stats.running_sums(rows, "period_rank", {"s": F.sum("target"), "n": F.count("target")}, MIN_TRAIN)
    mean = mean.select("fold", (F.col("s") / F.col("n")).alias("mean"))
    scored = gram.predict(validation(rows), gram.walk_forward_ridge(rows, "period_rank", POINTS, "target", MIN_TRAIN), POINTS, "ridge")
    scored = scored.join(F.broadcast(mean), "fold")  # one row per fold
    return scored.withColumn("last5", F.coalesce("prior_points_last5", "mean"))


_SCORED = _RIDGE + f""",
v AS (SELECT x.period_rank - {MIN_TRAIN} AS fold, x.row_id, x.target, my AS mean, coalesce(prior_points_last5, my) AS last5,
 intercept + {' + '.join(f'b{i} * coalesce(x.{c}, d{i})' for i, c in enumerate(POINTS))} AS ridge
 FROM x JOIN co ON co.fold = x.period_rank - {MIN_TRAIN} JOIN md ON md.fold = co.fold JOIN a ON a.fold = co.fold)"""


@query("K13 K9", _SCORED + " SELECT fold, row_id, target, round(mean, 6) AS mean, round(last5, 6) + 0.0 AS last5, round(ridge, 5) + 0.0 AS ridge FROM v")
def walk_forward_points(tables):
    rows = points_predictions(tables).select("fold", "row_id", "target", F.round("mean", 6).alias("mean"), F.round("last5", 6).alias("last5"), F.round("ridge", 5).alias("ridge"))
    return rows


_MODELS = ("mean", "last5", "ridge")


@query("K13 K9 K40", _SCORED + " " + " UNION ALL ".join(
    f"SELECT fold, '{m}' AS model, count(*) AS rows, round(avg(abs(target - {m})), 5) AS mae, round(sqrt(avg(pow(target - {m}, 2))), 5) AS rmse, "
    f"round(1 - sum(pow(target - {m}, 2)) / nullif(regr_syy(target, target), 0), 5) + 0.0 AS r2 FROM v GROUP BY fold" for m in _MODELS))
def walk_forward_points_scores(tables):
    rows = materialize(points_predictions(tables))
    out = None
    for m in _MODELS:
        one = metrics.regression_scores(rows, "target", m, ["fold"]).withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("fold", "model", "rows", "mae", "rmse", "r2"), 5)
