"""Splits, decisions, scores and error slices."""

from pyspark.sql import functions as F

from pastward.functions.scalars import LABELS
from pastward.operators import decisions, metrics, slicing, splits
from pastward.operators.ratings import season_starts
from pastward.plans.common import rounded
from pastward.plans.registry import query

# ---- SQL building blocks -------------------------------------------------------------

_NORM = """
n AS (SELECT * REPLACE (p_home / (p_home + p_draw + p_away) AS p_home, p_draw / (p_home + p_draw + p_away) AS p_draw,
 p_away / (p_home + p_draw + p_away) AS p_away) FROM preds)"""
_ARG = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END"
_SECOND = "(CAST(p_home >= p_draw AS INT) + CAST(p_away > p_draw AS INT) = 1)"


def _overlay(t):
    return f"CASE WHEN p_draw >= {t} AND {_SECOND} AND greatest(p_home, p_draw, p_away) < 0.5 THEN 'D' ELSE {_ARG} END"


_HIT = "CASE actual WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END"
_BRIER = " + ".join(
    f"pow({p} - CAST(actual = '{x}' AS INT), 2)" for p, x in zip(decisions.PROBS, LABELS)
)
_SCORED = _NORM + f""",
s AS (SELECT *, {_ARG} AS argmax_prediction, {_overlay(0.24)} AS overlay_prediction, {_ARG} = actual AS argmax_correct,
 -ln(greatest({_HIT}, 1e-15)) AS row_log_loss, {_BRIER} AS row_brier, greatest(p_home, p_draw, p_away) AS confidence FROM n)"""


def _ratio0(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def _draw(label, actual="actual"):
    tp, pp, ap = f"count(*) FILTER ({label} = 'D' AND {actual} = 'D')", f"count(*) FILTER ({label} = 'D')", f"count(*) FILTER ({actual} = 'D')"
    p, r = _ratio0(tp, pp), _ratio0(tp, ap)
    return p, r, _ratio0(f"2 * {p} * {r}", f"({p} + {r})")


def _evaluate(label="argmax_prediction"):
    p, r, f1 = _draw(label)
    return (
        f"count(*) AS rows, round(avg(CAST({label} = actual AS INT)), 6) AS accuracy, round(avg(row_log_loss), 6) AS log_loss, "
        f"round(avg(row_brier), 6) AS brier_score, round({r}, 6) AS draw_recall, round({p}, 6) AS draw_precision, round({f1}, 6) AS draw_f1, "
        + ", ".join(f"count(*) FILTER ({label} = '{x}') AS pred_{x}" for x in LABELS) + ", "
        + ", ".join(f"round(avg({c}), 6) AS mean_prob_{x}" for c, x in zip(decisions.PROBS, LABELS))
    )


def scored(tables, threshold=0.24):
    return metrics.with_scores(tables.preds, "actual").withColumns({
        "overlay_prediction": decisions.overlay_label(threshold),
        "confidence": F.greatest(*decisions.PROBS),
    })


# ---- splits --------------------------------------------------------------------------

_RANKS = "r AS (SELECT season, row_number() OVER (ORDER BY min(match_date), season) AS k, count(*) OVER () AS n FROM matches GROUP BY season)"


@query("K1", "SELECT season, min(match_date) AS first_date, max(match_date) AS last_date, count(*) AS rows FROM matches GROUP BY season")
def ordered_seasons(tables):
    return splits.season_table(tables.matches, "season", "match_date")


@query("K2", f"""
WITH {_RANKS} SELECT match_id, m.season, CASE WHEN k < n THEN 'development' ELSE 'holdout' END AS part FROM matches m JOIN r ON r.season = m.season""")
def development_and_holdout(tables):
    dev, holdout = splits.development_split(tables.matches.select("match_id", "season", "match_date"), "season", "match_date")
    return dev.withColumn("part", F.lit("development")).unionByName(holdout.withColumn("part", F.lit("holdout"))).drop("match_date")


_FOLDS = _RANKS + """,
f AS (SELECT CAST(v.k - 2 AS INT) AS fold, s.season, CASE WHEN s.k < v.k THEN 'train' ELSE 'validation' END AS role
 FROM r v JOIN r s ON s.k <= v.k WHERE v.k > 2 AND v.k < v.n)"""


def _development(tables):
    rows = tables.matches.select("match_id", "season", "match_date")
    return splits.development_split(rows, "season", "match_date")[0]


@query("K3", f"WITH {_FOLDS} SELECT m.match_id, m.season, fold, role FROM matches m JOIN f ON f.season = m.season")
def walk_forward_folds(tables):
    return splits.walk_forward(_development(tables), "season", "match_date").drop("match_date")


@query("K4", f"""
WITH {_FOLDS}, d AS (SELECT fold, role, match_date FROM matches m JOIN f ON f.season = m.season)
SELECT fold, count(*) FILTER (role = 'train') AS train_rows, min(match_date) FILTER (role = 'train') AS train_min,
 max(match_date) FILTER (role = 'train') AS train_max, count(*) FILTER (role = 'validation') AS validation_rows,
 min(match_date) FILTER (role = 'validation') AS validation_min, max(match_date) FILTER (role = 'validation') AS validation_max,
 max(match_date) FILTER (role = 'train') < min(match_date) FILTER (role = 'validation') AS no_leak FROM d GROUP BY fold""")
def fold_date_windows(tables):
    return splits.fold_windows(splits.walk_forward(_development(tables), "season", "match_date"), "match_date")


@query("K5", """
WITH p AS (SELECT season, gameweek, row_number() OVER (ORDER BY season, gameweek) - 1 AS pos, count(*) OVER () AS n
 FROM (SELECT DISTINCT season, gameweek FROM player_rows))
SELECT x.row_id, x.gameweek, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part
FROM player_rows x JOIN p ON p.season = x.season AND p.gameweek = x.gameweek""")
def complete_period_split(tables):
    rows = tables.player_rows.select("row_id", "season", "gameweek")
    return splits.period_split(rows, ["season", "gameweek"]).drop("season")


@query("J4", """
WITH p AS (SELECT gameweek, row_number() OVER (ORDER BY gameweek) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT gameweek FROM player_rows)),
x AS (SELECT player_id, pos < floor(n * 0.8) AS train FROM player_rows r JOIN p ON p.gameweek = r.gameweek)
SELECT player_id FROM x WHERE train INTERSECT SELECT player_id FROM x WHERE NOT train""")
def players_on_both_sides(tables):
    rows = splits.period_split(tables.player_rows.select("player_id", "gameweek"), ["gameweek"])
    return splits.overlap(rows.filter("part = 'train'"), rows.filter("part = 'test'"), ["player_id"])


@query("K6", """
WITH p AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) - 1 AS pos, count(*) OVER () AS n FROM matches),
f AS (SELECT match_id, pos, CAST(k AS INT) AS fold, n - (6 - k) * (n // 6) AS start, n // 6 AS size FROM p, range(1, 6) g(k))
SELECT match_id, pos AS position, fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM f WHERE pos < start + size""")
def time_series_folds(tables):
    rows = tables.matches.select("match_id", "match_date")
    out = splits.time_series_folds(rows, "match_date", ["match_id"], 5)
    return out.select("match_id", F.col("position").cast("bigint").alias("position"), "fold", "role")


@query("K7", f"""
WITH {_RANKS}, f AS (SELECT CAST(v.k - 2 AS INT) AS fold, s.season,
 CASE WHEN s.k = v.k THEN 'validate' WHEN s.k = v.k - 1 THEN 'calibrate' ELSE 'fit' END AS role
 FROM r v JOIN r s ON s.k <= v.k WHERE v.k > 2 AND v.k < v.n)
SELECT fold, role, count(*) AS rows, min(match_date) AS first_date, max(match_date) AS last_date
FROM matches m JOIN f ON f.season = m.season GROUP BY fold, role""")
def fit_calibrate_validate(tables):
    rows = splits.fit_calibrate_validate(_development(tables), "season", "match_date")
    return rows.groupBy("fold", "role").agg(
        F.count("*").alias("rows"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")
    )


@query("K47", f"WITH {_RANKS} SELECT count(*) AS development_rows FROM matches m JOIN r ON r.season = m.season WHERE k < n")
def holdout_guard(tables):
    guarded = splits.assert_absent(_development(tables), "season", splits.last_season(tables.matches, "season", "match_date"))
    return guarded.agg(F.count("*").alias("development_rows"))


@query("K8", f"""
WITH {_RANKS}, c AS (SELECT count(*) FILTER (actual = 'H') AS h, count(*) FILTER (actual = 'D') AS d, count(*) FILTER (actual = 'A') AS a, count(*) AS n
 FROM preds p JOIN r ON r.season = p.season WHERE k < r.n),
b AS (SELECT CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS majority, h / n AS p_home, d / n AS p_draw, a / n AS p_away FROM c),
v AS (SELECT actual, majority, b.p_home, b.p_draw, b.p_away FROM preds p JOIN r ON r.season = p.season, b WHERE k = r.n)
SELECT majority, count(*) AS rows, round(avg(CAST(actual = majority AS INT)), 6) AS accuracy, round(avg(-ln(greatest({_HIT}, 1e-15))), 6) AS log_loss,
 round(avg({_BRIER}), 6) AS brier_score FROM v GROUP BY majority""")
def majority_baseline(tables):
    train, holdout = splits.development_split(tables.preds, "season", "match_date")
    base = splits.majority_baseline(train, "actual", LABELS)  # one row
    rows = holdout.select("actual").join(F.broadcast(base)).withColumnsRenamed(
        {f"share_{x}": p for x, p in zip(LABELS, decisions.PROBS)}
    )
    out = metrics.evaluate(rows, "actual", ["majority"], "majority")
    return rounded(out.select("majority", "rows", "accuracy", "log_loss", "brier_score"))


# ---- decisions -----------------------------------------------------------------------


@query("K17 K18 K19 K20 K30 K31", _NORM.replace("n AS", "WITH n AS") + f"""
SELECT match_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, actual,
 {_ARG} AS argmax_prediction,
 CASE WHEN ap THEN 'D' ELSE {_ARG} END AS overlay_prediction, ap AS draw_overlay_applied, round(greatest(p_home, p_draw, p_away), 6) AS confidence,
 (ap OR {_ARG} = 'D' OR p_draw >= 0.24) AS draw_risk_flag,
 CASE WHEN p_draw >= 0.26 AND greatest(p_home, p_away) - p_draw <= 0.06 THEN 'D' ELSE {_ARG} END AS rule_prediction,
 {_ARG} = actual AS was_correct_argmax, CASE WHEN ap THEN 'D' ELSE {_ARG} END = actual AS was_correct_overlay
FROM (SELECT *, {_ARG} <> 'D' AND p_draw >= 0.24 AND {_SECOND} AND greatest(p_home, p_draw, p_away) < 0.5 AS ap FROM n)""")
def prediction_rows(tables):
    rows = decisions.prediction_rows(tables.preds.select("match_id", "actual", *decisions.PROBS), 0.24)
    rows = rows.withColumns({
        "rule_prediction": decisions.draw_rule_label(0.26, 0.06),
        "was_correct_argmax": F.col("argmax_prediction") == F.col("actual"),
        "was_correct_overlay": F.col("overlay_prediction") == F.col("actual"),
    })
    return rounded(rows)


_THRESHOLDS = decisions.OVERLAY_GRID + (0.38, 0.42, 0.46, 0.49)
_GRID = ", ".join(f"({t})" for t in _THRESHOLDS)
_P, _R, _F1 = _draw("label")
_OVERLAY_CTE = _NORM + f""",
g AS (SELECT season, actual, CAST(t AS DOUBLE) AS draw_threshold, {_ARG} AS base, {_overlay('t')} AS label FROM n, (VALUES {_GRID}) v(t)),
k AS (SELECT season, draw_threshold, count(*) AS rows, count(*) FILTER (label = 'D' AND base <> 'D') AS changed_to_draw,
 count(*) FILTER (label = 'D') AS predicted_draws, count(*) FILTER (label = actual) / count(*) AS accuracy,
 {_P} AS draw_precision, {_R} AS draw_recall, {_F1} AS draw_f1, count(*) FILTER (base = actual) / count(*) AS argmax_accuracy FROM g GROUP BY season, draw_threshold)"""
_OVERLAY_COLS = """season, draw_threshold, rows, changed_to_draw, predicted_draws, round(accuracy, 6) AS accuracy, round(draw_precision, 6) AS draw_precision,
 round(draw_recall, 6) AS draw_recall, round(draw_f1, 6) AS draw_f1, round(argmax_accuracy, 6) AS argmax_accuracy"""


@query("K21", f"WITH {_OVERLAY_CTE} SELECT {_OVERLAY_COLS}, accuracy < argmax_accuracy - 0.01 AS rejected FROM k")
def overlay_threshold_candidates(tables):
    return rounded(decisions.overlay_candidates(tables.preds, "actual", ["season"], _THRESHOLDS))


@query("K21", f"""
WITH {_OVERLAY_CTE} SELECT {_OVERLAY_COLS} FROM k WHERE accuracy >= argmax_accuracy - 0.01
QUALIFY row_number() OVER (PARTITION BY season ORDER BY k.draw_f1 DESC, k.accuracy DESC, changed_to_draw, draw_threshold DESC) = 1""")
def selected_overlay_threshold(tables):
    return rounded(decisions.select_overlay_threshold(tables.preds, "actual", ["season"], _THRESHOLDS))


_RULES = ", ".join(f"({t}, {m})" for t in decisions.RULE_THRESHOLDS for m in decisions.RULE_MARGINS)


@query("K22", f"""
WITH {_NORM},
g AS (SELECT actual, CAST(t AS DOUBLE) AS draw_threshold, CAST(mg AS DOUBLE) AS draw_margin, {_ARG} AS base,
 CASE WHEN p_draw >= CAST(t AS DOUBLE) AND greatest(p_home, p_away) - p_draw <= CAST(mg AS DOUBLE) THEN 'D' ELSE {_ARG} END AS label FROM n, (VALUES {_RULES}) v(t, mg)),
k AS (SELECT draw_threshold, draw_margin, count(*) AS rows, count(*) FILTER (label = 'D' AND base <> 'D') AS changed_to_draw,
 count(*) FILTER (label = 'D') AS predicted_draws, count(*) FILTER (label = actual) / count(*) AS accuracy,
 {_P} AS draw_precision, {_R} AS draw_recall, {_F1} AS draw_f1, count(*) FILTER (base = actual) / count(*) AS argmax_accuracy FROM g GROUP BY draw_threshold, draw_margin)
SELECT draw_margin, {_OVERLAY_COLS.replace('season, ', '')} FROM k WHERE accuracy >= argmax_accuracy - 0.03
ORDER BY k.draw_f1 DESC, k.accuracy DESC, k.draw_precision DESC, predicted_draws, draw_threshold, draw_margin LIMIT 1""")
def selected_draw_rule(tables):
    return rounded(decisions.select_draw_rule(tables.preds, "actual"))


_TEMPS = ", ".join(f"({t})" for t in decisions.TEMPERATURES)
_BLENDS = ", ".join(f"({a})" for a in decisions.BLENDS)
_CAL = f"""
WITH {_NORM}, c AS (SELECT count(*) FILTER (actual = 'H') / count(*) AS qh, count(*) FILTER (actual = 'D') / count(*) AS qd, count(*) FILTER (actual = 'A') / count(*) AS qa FROM n),
t AS (SELECT actual, CAST(tt AS DOUBLE) AS temperature, exp(ln(greatest(p_home, 1e-12)) / tt) AS eh, exp(ln(greatest(p_draw, 1e-12)) / tt) AS ed,
 exp(ln(greatest(p_away, 1e-12)) / tt) AS ea FROM n, (VALUES {_TEMPS}) v(tt)),
b AS (SELECT actual, temperature, CAST(al AS DOUBLE) AS alpha, (1 - al) * eh / (eh + ed + ea) + al * qh AS p_home, (1 - al) * ed / (eh + ed + ea) + al * qd AS p_draw,
 (1 - al) * ea / (eh + ed + ea) + al * qa AS p_away FROM t, (VALUES {_BLENDS}) w(al), c),
k AS (SELECT temperature, alpha, avg(-ln(greatest({_HIT}, 1e-15))) AS log_loss, avg({_BRIER}) AS brier_score FROM b GROUP BY temperature, alpha)"""


@query("K23 K24", _CAL + " SELECT temperature, alpha, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score FROM k")
def calibration_candidates(tables):
    return rounded(decisions.calibration_candidates(tables.preds, "actual"))


@query("K24", _CAL + """ SELECT temperature, alpha, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score FROM k
ORDER BY k.log_loss, k.brier_score, abs(temperature - 1), alpha LIMIT 1""")
def selected_calibration(tables):
    return rounded(decisions.select_calibration(tables.preds, "actual"))


# ---- scores --------------------------------------------------------------------------


@query("K25 K28", f"WITH {_SCORED} SELECT season, {_evaluate()} FROM s GROUP BY season")
def evaluation_by_season(tables):
    return rounded(metrics.evaluate(tables.preds, "actual", ["season"]))


def _class_sql(x):
    p = _ratio0(f"count(*) FILTER (argmax_prediction = '{x}' AND actual = '{x}')", f"count(*) FILTER (argmax_prediction = '{x}')")
    r = _ratio0(f"count(*) FILTER (argmax_prediction = '{x}' AND actual = '{x}')", f"count(*) FILTER (actual = '{x}')")
    f1 = _ratio0(f"2 * {p} * {r}", f"({p} + {r})")
    return f"SELECT '{x}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f1}, 6) AS f1, count(*) FILTER (actual = '{x}') AS support FROM s"


@query("K26", f"WITH {_SCORED} " + " UNION ALL ".join(_class_sql(x) for x in LABELS))
def class_scores(tables):
    return rounded(metrics.class_table(scored(tables), "actual", "argmax_prediction"))


@query("K27", f"WITH {_SCORED} SELECT l.x AS actual, " + ", ".join(f"count(*) FILTER (overlay_prediction = '{x}') AS pred_{x}" for x in LABELS)
       + " FROM (VALUES ('H'), ('D'), ('A')) l(x) LEFT JOIN s ON s.actual = l.x GROUP BY l.x")
def confusion_matrix(tables):
    return metrics.confusion(scored(tables), "actual", "overlay_prediction")


@query("K28 K35", f"WITH {_SCORED} SELECT season, " + ", ".join(
    f"count(*) FILTER ({c} = '{x}') AS {n}_{x}" for n, c in (("actual", "actual"), ("argmax", "argmax_prediction"), ("overlay", "overlay_prediction")) for x in LABELS
) + " FROM s GROUP BY season")
def label_distributions(tables):
    labels = {"actual": "actual", "argmax": "argmax_prediction", "overlay": "overlay_prediction"}
    return metrics.label_counts(scored(tables), labels, ["season"])


def _health_sql():
    cols = ["count(*) AS prediction_count", "count(actual) AS scored_count"]
    cols += [f"round(avg(CAST({m}_prediction = actual AS INT)), 6) AS accuracy_{m}" for m in ("argmax", "overlay")]
    cols += ["round(avg(row_log_loss), 6) AS log_loss", "round(avg(row_brier), 6) AS brier"]
    for m in ("argmax", "overlay"):
        p, r, f1 = _draw(f"{m}_prediction")
        cols += [f"round({r}, 6) AS draw_recall_{m}", f"round({p}, 6) AS draw_precision_{m}", f"round({f1}, 6) AS draw_f1_{m}"]
    for x, n in zip(LABELS, ("home", "draw", "away")):
        cols += [f"round(count(*) FILTER (argmax_prediction = '{x}') / count(*), 6) AS {n}_pred_rate_argmax",
                 f"round(count(*) FILTER (actual = '{x}') / count(*), 6) AS {n}_actual_rate"]
    cols.append("CASE WHEN count(*) < 5 THEN 'LOW_SAMPLE_SIZE' END AS notes")
    return ", ".join(cols)


@query("K29", f"WITH {_SCORED} SELECT league, season, match_date, {_health_sql()} FROM s GROUP BY league, season, match_date")
def health_metrics(tables):
    return rounded(metrics.health_row(scored(tables), "actual", ["league", "season", "match_date"]))


# Three models from one set of probabilities: as given, flattened, and mixed with equal shares.
_MODELS_SQL = _NORM + f""",
t AS (SELECT *, exp(ln(greatest(p_home, 1e-12)) / 1.5) AS eh, exp(ln(greatest(p_draw, 1e-12)) / 1.5) AS ed, exp(ln(greatest(p_away, 1e-12)) / 1.5) AS ea FROM n),
m0 AS (SELECT 'plain' AS model, season AS fold, actual, p_home, p_draw, p_away FROM n
 UNION ALL SELECT 'tempered', season, actual, eh / (eh + ed + ea), ed / (eh + ed + ea), ea / (eh + ed + ea) FROM t
 UNION ALL SELECT 'blended', season, actual, 0.8 * p_home + 0.2 * (1 / 3.0::DOUBLE), 0.8 * p_draw + 0.2 * (1 / 3.0::DOUBLE), 0.8 * p_away + 0.2 * (1 / 3.0::DOUBLE) FROM n),
ms AS (SELECT *, CASE model WHEN 'blended' THEN {_overlay(0.24)} ELSE {_ARG} END AS argmax_prediction,
 -ln(greatest({_HIT}, 1e-15)) AS row_log_loss, {_BRIER} AS row_brier FROM m0),
res AS (SELECT model, fold, count(*) AS rows, avg(CAST(argmax_prediction = actual AS INT)) AS accuracy, avg(row_log_loss) AS log_loss, avg(row_brier) AS brier_score,
 {_draw('argmax_prediction')[1]} AS draw_recall, {_draw('argmax_prediction')[0]} AS draw_precision, {_draw('argmax_prediction')[2]} AS draw_f1,
 {', '.join(f"count(*) FILTER (argmax_prediction = '{x}') AS pred_{x}" for x in LABELS)},
 {', '.join(f"avg({c}) AS mean_prob_{x}" for c, x in zip(decisions.PROBS, LABELS))} FROM ms GROUP BY model, fold)"""


def fold_results(tables):
    base = tables.preds.select(F.col("season").alias("fold"), "actual", *[p.alias(n) for p, n in zip(decisions.normalized(), decisions.PROBS)])
    third = F.lit(1.0) / 3

    def struct(name, probs):
        return F.struct(F.lit(name).alias("model"), *[p.alias(n) for p, n in zip(probs, decisions.PROBS)])

    variants = F.array(
        struct("plain", [F.col(p) for p in decisions.PROBS]),
        struct("tempered", decisions.tempered(1.5)),
        struct("blended", decisions.blended(0.2, [third] * 3)),
    )
    rows = base.select("fold", "actual", F.explode(variants).alias("v")).select("fold", "actual", "v.*")
    rows = rows.withColumn("label", F.when(F.col("model") == "blended", decisions.overlay_label(0.24)).otherwise(decisions.argmax_label()))
    return metrics.evaluate(rows, "actual", ["model", "fold"], "label")


_METRIC_ROUND = ", ".join(f"round(avg({m}), 6) AS {m}, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std" for m in metrics.METRICS)


@query("K32 E19", f"""
WITH {_MODELS_SQL} SELECT model, count(DISTINCT fold) AS folds, {_METRIC_ROUND}, {', '.join(f'CAST(sum(pred_{x}) AS BIGINT) AS pred_{x}' for x in LABELS)},
 {', '.join(f'round(avg(mean_prob_{x}), 6) AS mean_prob_{x}' for x in LABELS)} FROM res GROUP BY model""")
def model_leaderboard(tables):
    return rounded(metrics.leaderboard(fold_results(tables)))


def _delta_sql(a, b):
    return "d AS (SELECT a.fold, " + ", ".join(f"a.{m} - b.{m} AS {m}_delta" for m in metrics.METRICS) + \
        f" FROM res a JOIN res b ON b.fold = a.fold WHERE a.model = '{a}' AND b.model = '{b}')"


@query("K33", f"WITH {_MODELS_SQL}, {_delta_sql('tempered', 'plain')} SELECT fold, " + ", ".join(f"round({m}_delta, 6) + 0.0 AS {m}_delta" for m in metrics.METRICS) + " FROM d")
def model_fold_deltas(tables):
    return rounded(metrics.fold_deltas(fold_results(tables), "tempered", "plain"))


@query("K33", f"""
WITH {_MODELS_SQL}, {_delta_sql('tempered', 'plain')}
SELECT round(avg(log_loss_delta), 6) + 0.0 AS aggregate_log_loss_delta, round(avg(brier_score_delta), 6) + 0.0 AS aggregate_brier_delta,
 round(max(log_loss_delta), 6) + 0.0 AS max_fold_log_loss_delta,
 avg(log_loss_delta) <= -0.003 AND avg(brier_score_delta) <= -0.003 AND max(log_loss_delta) <= 0.005 AS passes FROM d""")
def model_promotion_gate(tables):
    return rounded(metrics.promotion_gate(metrics.fold_deltas(fold_results(tables), "tempered", "plain")))


@query("K33", f"""
WITH {_MODELS_SQL}, {_delta_sql('blended', 'plain')},
g AS (SELECT bool_and(draw_f1_delta > 0) AS draw_f1_improved, bool_and(draw_recall_delta > 0) AS draw_recall_improved,
 max(greatest(0.0, -accuracy_delta)) AS drop_, bool_and(abs(log_loss_delta) < 1e-12 AND abs(brier_score_delta) < 1e-12) AS probabilities_unchanged FROM d)
SELECT draw_f1_improved, draw_recall_improved, round(drop_, 6) AS max_accuracy_drop, probabilities_unchanged,
 draw_f1_improved AND draw_recall_improved AND drop_ <= 0.02 AND probabilities_unchanged AS passes FROM g""")
def draw_rule_gate(tables):
    return rounded(metrics.draw_rule_gate(metrics.fold_deltas(fold_results(tables), "blended", "plain")))


@query("K46", f"""
WITH {_OVERLAY_CTE},
b AS (SELECT * FROM k WHERE accuracy >= argmax_accuracy - 0.01 QUALIFY row_number() OVER (PARTITION BY season ORDER BY draw_f1 DESC, accuracy DESC, changed_to_draw, draw_threshold DESC) = 1),
a AS (SELECT season, {_draw('base')[1]} AS r0, {_draw('base')[2]} AS f0 FROM g WHERE draw_threshold = 0.2 GROUP BY season),
l0 AS (SELECT season, avg(-ln(greatest({_HIT}, 1e-15))) AS ll, avg({_BRIER}) AS bs FROM n GROUP BY season),
l1 AS (SELECT n.season, avg(-ln(greatest({_HIT}, 1e-15))) AS ll, avg({_BRIER}) AS bs FROM n JOIN b ON b.season = n.season GROUP BY n.season),
f AS (SELECT b.*, b.draw_f1 - a.f0 AS f1d, b.draw_recall - a.r0 AS rd, b.accuracy - b.argmax_accuracy AS ad, l1.ll - l0.ll AS lld, l1.bs - l0.bs AS bsd
 FROM b JOIN a USING (season) JOIN l0 USING (season) JOIN l1 USING (season)),
o AS (SELECT bool_and(f1d >= 0.03) AS draw_f1_gains_enough, bool_and(rd > 0) AS draw_recall_gains, bool_and(ad >= -0.01) AS accuracy_holds,
 max(draw_threshold) - min(draw_threshold) <= 0.06 AS threshold_stable, bool_and(abs(lld) < 1e-12 AND abs(bsd) < 1e-12) AS probabilities_unchanged, bool_and(changed_to_draw <= 0.15 * rows) AS changes_bounded FROM f)
SELECT *, draw_f1_gains_enough AND draw_recall_gains AND accuracy_holds AND threshold_stable AND probabilities_unchanged AND changes_bounded AS accepted FROM o""")
def overlay_acceptance(tables):
    best = decisions.select_overlay_threshold(tables.preds, "actual", ["season"], _THRESHOLDS)
    plain = metrics.evaluate(tables.preds, "actual", ["season"]).select(
        "season", F.col("draw_recall").alias("r0"), F.col("draw_f1").alias("f0"), F.col("log_loss").alias("l0"), F.col("brier_score").alias("b0")
    )
    chosen = tables.preds.join(best.select("season", F.col("draw_threshold").alias("_threshold")), "season")
    chosen = metrics.with_scores(chosen, "actual").withColumn("overlay_prediction", decisions.overlay_label(F.col("_threshold")))
    overlaid = metrics.evaluate(chosen, "actual", ["season"], "overlay_prediction").select("season", F.col("log_loss").alias("l1"), F.col("brier_score").alias("b1"))
    folds = best.join(plain, "season").join(overlaid, "season").select(
        "season", "rows", "draw_threshold", "changed_to_draw",
        (F.col("draw_f1") - F.col("f0")).alias("draw_f1_delta"), (F.col("draw_recall") - F.col("r0")).alias("draw_recall_delta"),
        (F.col("accuracy") - F.col("argmax_accuracy")).alias("accuracy_delta"),
        (F.col("l1") - F.col("l0")).alias("log_loss_delta"), (F.col("b1") - F.col("b0")).alias("brier_score_delta"),
    )
    return metrics.overlay_gates(folds)


# Accuracy, log loss and Brier score of three published models.
_BASELINES = (("majority", 0.4342, 1.0682, 0.6469), ("logistic", 0.5474, 0.9890, 0.5875), ("logistic_elo", 0.5579, 0.9705, 0.5730))


@query("K48", f"""
WITH {_SCORED}, e AS (SELECT avg(CAST(argmax_correct AS INT)) AS acc, avg(row_log_loss) AS ll, avg(row_brier) AS br FROM s),
b(baseline, a0, l0, b0) AS (VALUES {', '.join(str(b) for b in _BASELINES)})
SELECT baseline, round(acc - a0::DOUBLE, 6) + 0.0 AS accuracy_delta, round(ll - l0::DOUBLE, 6) + 0.0 AS log_loss_delta, round(br - b0::DOUBLE, 6) + 0.0 AS brier_score_delta,
 rank() OVER (ORDER BY l0) = 1 AS best_by_log_loss FROM b, e""")
def against_published(tables):
    base = tables.spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("baseline"), F.lit(a).alias("accuracy"), F.lit(l).alias("log_loss"), F.lit(b).alias("brier_score"))
        for n, a, l, b in _BASELINES
    ])).alias("b")).select("b.*")
    out = metrics.against_baselines(metrics.evaluate(tables.preds, "actual"), base)
    best = min(_BASELINES, key=lambda row: row[2])[0]
    return rounded(out).withColumn("best_by_log_loss", F.col("baseline") == best)


# ---- slices --------------------------------------------------------------------------

_INF = float("inf")


def _bins_sql(value, edges, labels):
    parts = []
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        conds = ([f"{value} >= {low}"] if low != -_INF else []) + ([f"{value} < {high}"] if high != _INF else [])
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


def _bin_table_sql(value, edges, labels, columns):
    grid = ", ".join(f"('{x}')" for x in labels)
    return f"""SELECT l.bin, count(x.match_id) AS count, {columns} FROM (VALUES {grid}) l(bin)
LEFT JOIN (SELECT *, {_bins_sql(value, edges, labels)} AS bin FROM s) x ON x.bin = l.bin GROUP BY l.bin"""


_DRAW_EDGES = [0.0, 0.15, 0.20, 0.25, 0.30, 0.35, _INF]
_DRAW_BINS = ["0.00-0.15", "0.15-0.20", "0.20-0.25", "0.25-0.30", "0.30-0.35", "0.35+"]


@query("K34", f"WITH {_SCORED} " + _bin_table_sql("p_draw", _DRAW_EDGES, _DRAW_BINS, """
 CASE WHEN count(match_id) > 0 THEN count(*) FILTER (actual = 'D') END AS actual_draw_count,
 round(avg(CAST(actual = 'D' AS INT)), 6) AS actual_draw_rate,
 CASE WHEN count(match_id) > 0 THEN count(*) FILTER (argmax_prediction = 'D') END AS argmax_draw_count,
 CASE WHEN count(match_id) > 0 THEN count(*) FILTER (overlay_prediction = 'D') END AS overlay_draw_count"""))
def draw_probability_bins(tables):
    return rounded(slicing.bin_table(scored(tables), "p_draw", _DRAW_EDGES, _DRAW_BINS, {
        "actual_draw_count": F.count_if(F.col("actual") == "D"),
        "actual_draw_rate": slicing.share(F.col("actual") == "D"),
        "argmax_draw_count": F.count_if(F.col("argmax_prediction") == "D"),
        "overlay_draw_count": F.count_if(F.col("overlay_prediction") == "D"),
    }))


_CONF_EDGES = [0.0, 0.40, 0.50, 0.60, 0.70, _INF]
_CONF_BINS = ["0.00-0.40", "0.40-0.50", "0.50-0.60", "0.60-0.70", "0.70+"]


@query("K34", f"WITH {_SCORED}, t AS (" + _bin_table_sql("confidence", _CONF_EDGES, _CONF_BINS, """
 avg(CAST(argmax_correct AS INT)) AS accuracy, avg(row_log_loss) AS mean_log_loss, sum(row_log_loss) AS total_log_loss,
 CASE WHEN count(match_id) > 0 THEN count(*) FILTER (NOT argmax_correct) END AS wrong_count""") + """)
SELECT bin, count, round(accuracy, 6) AS accuracy, round(mean_log_loss, 6) AS mean_log_loss, round(total_log_loss, 4) AS total_log_loss, wrong_count,
 round(total_log_loss / (sum(total_log_loss) OVER ()), 6) AS log_loss_share FROM t""")
def confidence_bins(tables):
    out = slicing.confidence_table(scored(tables), _CONF_EDGES, _CONF_BINS)
    return rounded(out.withColumn("total_log_loss", F.round("total_log_loss", 4)))


@query("K34", f"""
WITH {_SCORED} SELECT count(*) FILTER (actual = 'D') AS actual_draw_count, count(*) FILTER (argmax_prediction = 'D') AS argmax_predicted_draw_count,
 count(*) FILTER (overlay_prediction = 'D') AS overlay_predicted_draw_count, count(*) FILTER (actual = 'D' AND argmax_prediction <> 'D') AS argmax_draw_miss_count,
 count(*) FILTER (actual = 'D' AND overlay_prediction <> 'D') AS overlay_draw_miss_count, round(avg(p_draw) FILTER (actual = 'D'), 6) AS average_p_draw_for_draws,
 round(avg(p_draw) FILTER (actual <> 'D'), 6) AS average_p_draw_for_others FROM s""")
def draw_failures(tables):
    return rounded(slicing.draw_failures(scored(tables), "actual"))


@query("K35", f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT '{x}' AS prediction, " + ", ".join(
        f"count(*) FILTER ({m}_prediction = '{x}') AS {m}_count, round(avg(CAST(actual = '{x}' AS INT)) FILTER ({m}_prediction = '{x}'), 6) AS {m}_accuracy"
        for m in ("argmax", "overlay")) + " FROM s" for x in LABELS))
def accuracy_when_predicted(tables):
    return rounded(slicing.prediction_accuracy(scored(tables), "actual"))


@query("K35", f"WITH {_SCORED} SELECT " + ", ".join(
    f"count(*) FILTER ({m}_prediction = 'H') - count(*) FILTER (actual = 'H') AS {m}_home_overprediction, "
    f"round((count(*) FILTER ({m}_prediction = 'H') - count(*) FILTER (actual = 'H')) / count(*), 6) + 0.0 AS {m}_home_rate_gap, "
    f"count(*) FILTER ({m}_prediction = 'H') > count(*) FILTER (actual = 'H') AS {m}_overpredicted_home" for m in ("argmax", "overlay")) + " FROM s")
def home_bias(tables):
    return rounded(slicing.home_bias(scored(tables), "actual"))


_STAGE_SQL = _SCORED + """,
p AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY match_date, event_time, match_id) - 1 AS pos, count(*) OVER (PARTITION BY season) AS n FROM s),
st AS (SELECT *, CASE WHEN pos < n / 3 THEN 'early' WHEN pos < 2 * n / 3 THEN 'middle' ELSE 'late' END AS season_stage FROM p)"""


@query("F18", f"WITH {_STAGE_SQL} SELECT match_id, season, season_stage FROM st")
def season_stage(tables):
    rows = tables.preds.select("match_id", "season", "match_date", "event_time")
    return slicing.season_stage(rows, ["season"], "match_date", ["event_time", "match_id"]).select("match_id", "season", "season_stage")


@query("K36", f"WITH {_STAGE_SQL} SELECT season, season_stage, {_evaluate()} FROM st GROUP BY season, season_stage")
def stage_metrics(tables):
    rows = slicing.season_stage(tables.preds, ["season"], "match_date", ["event_time", "match_id"])
    return rounded(metrics.evaluate(rows, "actual", ["season", "season_stage"]))


_TEAM_SQL = _SCORED + """,
tr AS (SELECT league, home_team AS team, 'H' AS own, * EXCLUDE (league) FROM s UNION ALL SELECT league, away_team, 'A', * EXCLUDE (league) FROM s),
te AS (SELECT league, team, count(*) AS matches, round(avg(CAST(argmax_correct AS INT)), 6) AS argmax_accuracy, round(avg(CAST(overlay_prediction = actual AS INT)), 6) AS overlay_accuracy,
 count(*) FILTER (actual = 'D' AND argmax_prediction <> 'D') AS draw_miss_count, round(avg(row_log_loss), 6) AS mean_log_loss,
 count(*) FILTER (argmax_prediction = own AND actual <> own) AS overpredicted_as_winner FROM tr GROUP BY league, team)"""


@query("K37", f"WITH {_TEAM_SQL} SELECT * FROM te")
def team_errors(tables):
    return rounded(slicing.team_errors(scored(tables), "actual", ["league"]))


@query("K37 I1", f"WITH {_TEAM_SQL} SELECT * FROM te ORDER BY argmax_accuracy, mean_log_loss DESC, league, team LIMIT 10")
def worst_teams(tables):
    rows = rounded(slicing.team_errors(scored(tables), "actual", ["league"]))
    return rows.orderBy("argmax_accuracy", F.col("mean_log_loss").desc(), "league", "team").limit(10)


@query("K39 I1", f"""
WITH {_SCORED} SELECT match_id, match_date, home_team, away_team, actual, argmax_prediction, overlay_prediction, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw,
 round(p_away, 6) AS p_away, round(row_log_loss, 6) AS row_log_loss FROM s ORDER BY round(row_log_loss, 9) DESC, match_id LIMIT 20""")
def largest_log_losses(tables):
    rows = scored(tables).orderBy(F.round("row_log_loss", 9).desc(), "match_id").limit(20)
    return rounded(rows.select(
        "match_id", "match_date", "home_team", "away_team", "actual", "argmax_prediction", "overlay_prediction",
        *decisions.PROBS, "row_log_loss",
    ))


from pastward.plans.standings import DIVISION_ROWS, STARTS_SQL  # noqa: E402


@query("K38", f"""
WITH {DIVISION_ROWS}{STARTS_SQL.replace('FROM matches ', 'FROM division ').replace('FROM team_rows ', 'FROM rows_g ')}, {_SCORED},
q AS (SELECT s.*, EXISTS (SELECT 1 FROM starts t WHERE t.initialization = 'promoted_or_returning' AND t.league = s.league AND t.season = s.season
 AND t.team IN (s.home_team, s.away_team)) AS flag FROM s WHERE s.match_id IN (SELECT match_id FROM division))
SELECT l.segment, count(q.match_id) AS count, round(avg(CAST(argmax_correct AS INT)), 6) AS accuracy, round(avg(row_log_loss), 6) AS log_loss,
 round(avg(row_brier), 6) AS brier_score, round(avg(CAST(actual = 'D' AS INT)), 6) AS draw_rate
FROM (VALUES ('with newcomer', true), ('without newcomer', false)) l(segment, f) LEFT JOIN q ON q.flag = l.f GROUP BY l.segment""")
def newcomer_segment(tables):
    new = season_starts(tables.division, "league", "season", "event_time").filter(F.col("initialization") == "promoted_or_returning")
    rows = scored(tables).join(tables.division.select("match_id"), "match_id", "left_semi")
    for side in ("home", "away"):
        flags = new.select("league", "season", F.col("team").alias(f"{side}_team"), F.lit(True).alias(f"_{side}_new"))
        rows = rows.join(flags, ["league", "season", f"{side}_team"], "left")
    flag = F.coalesce("_home_new", "_away_new", F.lit(False))
    return rounded(slicing.two_segments(rows, flag, ("with newcomer", "without newcomer"), {
        "accuracy": slicing.share(F.col("argmax_correct")), "log_loss": F.avg("row_log_loss"),
        "brier_score": F.avg("row_brier"), "draw_rate": slicing.share(F.col("actual") == "D"),
    }))
