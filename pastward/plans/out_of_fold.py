"""Out-of-fold predictions of three models that SQL can fit too, and what is decided on them."""

from pyspark.sql import functions as F

from pastward.operators import decisions, metrics, out_of_fold, scorelines
from pastward.plans.common import rounded
from pastward.plans.evaluation import _ARG, _BRIER, _HIT, _draw
from pastward.plans.registry import query
from pastward.plans.scorelines import OUTCOMES, folds, validation

_CELL = "CAST(greatest(-3, least(3, floor(2 * (coalesce(home_xg_overall_last5, 0) - coalesce(away_xg_overall_last5, 0))))) AS INT)"
_GRID = decisions.OVERLAY_GRID
_WEIGHT = 3.0


def stored(tables):
    """The store of this module's models: class shares, a table of shares per cell, and the scoreline distribution."""
    rows = folds(tables).withColumns({"result": F.expr("CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END"), "cell": F.expr(_CELL)})
    valid = validation(rows)
    prior = out_of_fold.prior_model(rows, "season_rank", "result")
    table = out_of_fold.table_model(rows, "season_rank", "result", "cell", weight=_WEIGHT)
    return out_of_fold.store({
        "prior": out_of_fold.predict_prior(valid, prior),
        "table": out_of_fold.predict_table(valid, table, prior, "cell"),
        "scoreline": scorelines.predict(valid, scorelines.fit_walk_forward(rows, "season_rank"), ["fold"], "gap"),
    }, "match_id", "result")


_SHARES = ", ".join(f"count(*) FILTER (result = '{x}') AS n{x}" for x in "HDA")
_STORE = OUTCOMES + f""",
pri AS (SELECT fold, count(*) AS n, {_SHARES} FROM fr WHERE role = 'train' GROUP BY fold),
cel AS (SELECT fold, {_CELL} AS cell, count(*) AS n, {_SHARES} FROM fr WHERE role = 'train' GROUP BY ALL),
val AS (SELECT *, {_CELL} AS cell FROM fr WHERE role = 'validation'),
oof AS MATERIALIZED (SELECT 'prior' AS model, v.fold, v.match_id, v.result AS actual, p.nH / p.n AS p_home, p.nD / p.n AS p_draw, p.nA / p.n AS p_away FROM val v JOIN pri p ON p.fold = v.fold
 UNION ALL SELECT 'table', v.fold, v.match_id, v.result, {', '.join(f"(coalesce(c.n{x}, 0) + {_WEIGHT} * p.n{x} / p.n) / (coalesce(c.n, 0) + {_WEIGHT})" for x in 'HDA')}
 FROM val v JOIN pri p ON p.fold = v.fold LEFT JOIN cel c ON c.fold = v.fold AND c.cell = v.cell
 UNION ALL SELECT 'scoreline', fold, match_id, result, p_home, p_draw, p_away FROM pr)"""


@query("K32 K11", f"WITH {_STORE} SELECT model, fold, match_id, actual, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away FROM oof")
def out_of_fold_predictions(tables):
    return rounded(stored(tables))


def _scores(label):
    p, r, f1 = _draw(label)
    return (f"count(*) AS rows, avg(CAST({label} = actual AS INT)) AS accuracy, avg(-ln(greatest({_HIT}, 1e-15))) AS log_loss, avg({_BRIER}) AS brier_score, "
            f"{r} AS draw_recall, {p} AS draw_precision, {f1} AS draw_f1")


_RESULTS = _STORE + f""",
lab AS (SELECT *, {_ARG} AS label FROM oof), res AS (SELECT model, fold, {_scores('label')} FROM lab GROUP BY model, fold)"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std" for m in metrics.METRICS)


@query("K32 E19", f"WITH {_RESULTS} SELECT model, count(DISTINCT fold) AS folds, {_MEANS} FROM res GROUP BY model")
def out_of_fold_leaderboard(tables):
    table = metrics.leaderboard(metrics.evaluate(stored(tables), "actual", ["model", "fold"]))
    return rounded(table.select("model", "folds", *[c for m in metrics.METRICS for c in (m, f"{m}_std")]))


@query("K33", f"WITH {_RESULTS} SELECT a.model, a.fold, " + ", ".join(f"round(a.{m} - b.{m}, 6) + 0.0 AS {m}_delta" for m in metrics.METRICS)
       + " FROM res a JOIN res b ON b.fold = a.fold AND b.model = 'prior' WHERE a.model <> 'prior'")
def out_of_fold_deltas(tables):
    results = metrics.evaluate(stored(tables), "actual", ["model", "fold"])
    out = None
    for model in ("table", "scoreline"):
        one = metrics.fold_deltas(results, model, "prior").withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("model", "fold", *[f"{m}_delta" for m in metrics.METRICS]))


_PF, _RF, _FF = _draw("label")
_CHOSEN = _STORE + f""",
gr AS (SELECT model, fold, actual, CAST(t AS DOUBLE) AS draw_threshold, {_ARG} AS base,
 CASE WHEN p_draw >= CAST(t AS DOUBLE) AND CAST(p_home >= p_draw AS INT) + CAST(p_away > p_draw AS INT) = 1 AND greatest(p_home, p_draw, p_away) < {decisions.DOMINANT} THEN 'D' ELSE {_ARG} END AS label
 FROM oof, (VALUES {', '.join(f'({t})' for t in _GRID)}) v(t)),
ca AS (SELECT model, fold, draw_threshold, count(*) FILTER (label = 'D' AND base <> 'D') AS changed, count(*) FILTER (label = actual) / count(*) AS accuracy, {_FF} AS f1,
 count(*) FILTER (base = actual) / count(*) AS argmax_accuracy FROM gr GROUP BY ALL),
ch AS (SELECT model, fold + 1 AS fold, draw_threshold FROM ca WHERE accuracy >= argmax_accuracy - {decisions.OVERLAY_ACCURACY_LOSS}
 QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY f1 DESC, accuracy DESC, changed, draw_threshold DESC) = 1),
us AS (SELECT o.*, ch.draw_threshold, CASE WHEN ch.draw_threshold IS NOT NULL AND p_draw >= ch.draw_threshold AND CAST(p_home >= p_draw AS INT) + CAST(p_away > p_draw AS INT) = 1
 AND greatest(p_home, p_draw, p_away) < {decisions.DOMINANT} THEN 'D' ELSE {_ARG} END AS label
 FROM oof o LEFT JOIN ch ON ch.model = o.model AND ch.fold = o.fold WHERE o.fold > 1)"""


@query("K21 K46", f"""
WITH {_CHOSEN} SELECT model, fold, draw_threshold, count(*) AS rows, round(avg(CAST(label = actual AS INT)), 6) AS accuracy, count(*) FILTER (label = 'D' AND {_ARG} <> 'D') AS changed_to_draw,
 round({_PF}, 6) AS draw_precision, round({_RF}, 6) AS draw_recall, round({_FF}, 6) AS draw_f1 FROM us GROUP BY model, fold, draw_threshold""")
def threshold_of_the_fold_before(tables):
    rows = out_of_fold.with_previous_threshold(stored(tables))
    out = metrics.evaluate(rows, "actual", ["model", "fold", "draw_threshold"], "label")
    changed = rows.groupBy("model", "fold").agg(F.count_if((F.col("label") == "D") & (decisions.argmax_label() != "D")).alias("changed_to_draw"))
    return rounded(out.join(changed, ["model", "fold"]).select(
        "model", "fold", "draw_threshold", "rows", "accuracy", "changed_to_draw", "draw_precision", "draw_recall", "draw_f1"))


_TEMPS, _BLENDS = (", ".join(f"({x})" for x in grid) for grid in (decisions.TEMPERATURES, decisions.BLENDS))


def _tempered(t):
    return ", ".join(f"exp(ln(greatest({p}, 1e-12)) / {t}) AS e{p[2]}" for p in decisions.PROBS)


_CALIBRATED = _STORE + f""",
sh AS (SELECT model, fold, {', '.join(f"count(*) FILTER (actual = '{x}') / count(*) AS q{x}" for x in 'HDA')} FROM oof GROUP BY model, fold),
te AS (SELECT model, fold, actual, CAST(t AS DOUBLE) AS temperature, {_tempered('CAST(t AS DOUBLE)')} FROM oof, (VALUES {_TEMPS}) v(t)),
mi AS (SELECT te.model, te.fold, actual, temperature, CAST(al AS DOUBLE) AS alpha, {', '.join(f"(1 - CAST(al AS DOUBLE)) * e{p[2]} / (eh + ed + ea) + CAST(al AS DOUBLE) * q{x} AS {p}" for p, x in zip(decisions.PROBS, 'HDA'))}
 FROM te JOIN sh ON sh.model = te.model AND sh.fold = te.fold, (VALUES {_BLENDS}) w(al)),
kk AS (SELECT model, fold, temperature, alpha, avg(-ln(greatest({_HIT}, 1e-15))) AS log_loss, avg({_BRIER}) AS brier_score FROM mi GROUP BY ALL),
be AS (SELECT model, fold + 1 AS fold, temperature, alpha FROM kk
 QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY round(log_loss, 12), round(brier_score, 12), abs(temperature - 1), alpha) = 1),
ap AS (SELECT o.model, o.fold, o.match_id, o.actual, be.temperature, be.alpha, o.p_home AS r_home, o.p_draw AS r_draw, o.p_away AS r_away, qH, qD, qA, {_tempered('be.temperature').replace('p_', 'o.p_')}
 FROM oof o JOIN be ON be.model = o.model AND be.fold = o.fold JOIN sh ON sh.model = o.model AND sh.fold = o.fold - 1),
ad AS (SELECT model, fold, actual, temperature, alpha, {', '.join(f"(1 - alpha) * e{p[2]} / (eh + ed + ea) + alpha * q{x} AS {p}" for p, x in zip(decisions.PROBS, 'HDA'))} FROM ap)"""


@query("K7 K23 K24", f"""
WITH {_CALIBRATED} SELECT model, fold, temperature, alpha, count(*) AS rows, round(avg(-ln(greatest({_HIT}, 1e-15))), 6) AS log_loss, round(avg({_BRIER}), 6) AS brier_score,
 round(avg(CAST({_ARG} = actual AS INT)), 6) AS accuracy FROM ad GROUP BY model, fold, temperature, alpha""")
def calibration_of_the_fold_before(tables):
    rows = out_of_fold.with_previous_calibration(stored(tables))
    out = metrics.evaluate(rows, "actual", ["model", "fold", "temperature", "alpha"])
    return rounded(out.select("model", "fold", "temperature", "alpha", "rows", "log_loss", "brier_score", "accuracy"))
