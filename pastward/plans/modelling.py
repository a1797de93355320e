"""Models and clusters. Fits differ between libraries, so only the number of rows is checked,
except for the naming of clusters, which is exact for a given assignment."""

from pyspark.sql import functions as F

from pastward.operators import decisions, match_features, metrics, models, splits
from pastward.operators.upsert import assert_no_existing
from pastward.plans.common import LEAGUE, rounded
from pastward.plans.history import style_form
from pastward.plans.players import _KW, collapsed
from pastward.plans.ranking import PERIOD
from pastward.plans.registry import query
from pastward.sources.tables import materialize

FEATURES = [
    "home_points_overall_last5", "away_points_overall_last5", "home_goal_diff_overall_last5", "away_goal_diff_overall_last5",
    "home_xg_overall_last5", "home_xga_overall_last5", "away_xg_overall_last5", "away_xga_overall_last5",
]
POINTS = ["prior_points_last3", "prior_points_last5", "prior_minutes_last5", "prior_goals_last5", "prior_xg_last5"]


def _match_sets(tables):
    base = match_features.base_match_features(tables.matches, tables.team_rows, LEAGUE)
    rows = materialize(base.select("match_id", "season", "match_date", "result", "home_goals", "away_goals", *FEATURES))
    return splits.development_split(rows, "season", "match_date")


def _class_scores(scored):
    rows = scored.withColumn("argmax_prediction", decisions.argmax_label())
    return rounded(metrics.evaluate(rows, "result"))


@query("K10")
def logistic_model_scores(tables):
    train, holdout = _match_sets(tables)
    return _class_scores(models.predict_classes(models.fit_logistic(train, FEATURES, "result"), holdout))


@query("K11")
def tree_classifier_scores(tables):
    train, holdout = _match_sets(tables)
    return _class_scores(models.predict_classes(models.fit_forest(train, FEATURES, "result"), holdout))


@query("K12")
def goal_regressor_scores(tables):
    train, holdout = _match_sets(tables)
    out = None
    for target in ("home_goals", "away_goals"):
        scored = models.predict_values(models.fit_boosted_regressor(train, FEATURES, target), holdout)
        one = metrics.regression_scores(scored, target, "prediction").select(F.lit(target).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _player_sets(tables):
    from pastward.operators.periods import prior_only_features

    rows = prior_only_features(collapsed(tables), "player_id", "season", "gameweek", "row_id", **_KW)
    rows = rows.withColumn("position", (F.col("player_id") % 4 + 1).cast("int"))
    rows = materialize(rows.select("player_id", *PERIOD, "position", F.col("total_points").alias("target"), *POINTS))
    marked = splits.period_split(rows, PERIOD)
    return marked.filter("part = 'train'"), marked.filter("part = 'test'")


@query("K13")
def ridge_scores(tables):
    train, test = _player_sets(tables)
    scored = models.predict_values(models.fit_ridge(train, POINTS, "target"), test)
    return rounded(metrics.regression_scores(scored, "target", "prediction"))


@query("K14")
def per_position_scores(tables):
    train, test = _player_sets(tables)
    scored = models.per_group_regressors(train, test, "position", [1, 2, 3, 4], POINTS, "target")
    own = metrics.regression_scores(scored, "target", "prediction", ["position"]).withColumn("scope", F.lit("position"))
    combined = metrics.regression_scores(scored, "target", "prediction").withColumns({"position": F.lit(None).cast("int"), "scope": F.lit("all")})
    known = test.withColumn("prediction", F.coalesce("prior_points_last5", F.lit(0.0)))
    average = metrics.regression_scores(known, "target", "prediction", ["position"]).withColumn("scope", F.lit("last5_average"))
    return rounded(own.unionByName(combined).unionByName(average))


@query("K15 B10")
def style_clusters(tables):
    rows = style_form(tables).filter(F.col("style_matches_last5") >= 5)
    rows = materialize(rows.select("match_id", "league", "team", *models.STYLE_INPUTS))
    # Clusters are those of the development seasons; the rows of the holdout are assigned to them.
    dated = rows.join(tables.matches.select("match_id", "season", "match_date"), "match_id")
    development, _ = splits.development_split(dated, "season", "match_date")
    model = models.fit_clusters(development, list(models.STYLE_INPUTS))
    clustered = models.assign_clusters(model, rows).withColumn("silhouette", F.lit(models.silhouette(model, rows)))
    return clustered.join(models.cluster_labels(clustered), "style_cluster").select("match_id", "league", "team", "style_cluster", "style_label", "silhouette")


_STYLE = """
c AS (SELECT team % 4 AS style_cluster, avg(deep) AS deep, avg(ppda) AS ppda, avg(xga) AS xga FROM (
 SELECT CAST(team AS BIGINT) AS team, CAST(match_id % 13 AS DOUBLE) AS deep, (goals_for + 1) * 1.0 / nullif(goals_against, 0) AS ppda, xg_against AS xga FROM team_rows) GROUP BY team % 4),
h AS (SELECT style_cluster FROM c ORDER BY ppda LIMIT 1), d AS (SELECT style_cluster FROM c WHERE style_cluster NOT IN (SELECT * FROM h) ORDER BY deep DESC LIMIT 1),
l AS (SELECT style_cluster FROM c WHERE style_cluster NOT IN (SELECT * FROM h UNION ALL SELECT * FROM d) ORDER BY xga DESC LIMIT 1)"""


@query("K16", f"""
WITH {_STYLE} SELECT style_cluster, CASE WHEN style_cluster IN (SELECT * FROM h) THEN 'High Press' WHEN style_cluster IN (SELECT * FROM d) THEN 'Direct Attack'
 WHEN style_cluster IN (SELECT * FROM l) THEN 'Low Control' ELSE 'Compact Defense' END AS style_label FROM c""")
def cluster_labels(tables):
    rows = tables.team_rows.select(
        (F.col("team") % 4).cast("bigint").alias("style_cluster"), F.expr("CAST((goals_for + 1) * 1.0 / nullif(goals_against, 0) AS DOUBLE)").alias("ppda_last5"),
        F.expr("CAST(match_id % 13 AS DOUBLE)").alias("deep_last5"), F.col("xg_against").alias("xga_last5"),
    )
    return models.cluster_labels(rows)


@query("B7 C23", "SELECT snapshot_id, run_id FROM snapshots WHERE run_id = (SELECT max(run_id) FROM snapshots)")
def rows_of_a_new_run(tables):
    rows = tables.snapshots.select("snapshot_id", "run_id")
    newest = rows.agg(F.max("run_id")).first()[0]
    added = rows.filter(F.col("run_id") == newest)
    assert_no_existing(added, rows.filter(F.col("run_id") < newest), ["snapshot_id"])
    return added
