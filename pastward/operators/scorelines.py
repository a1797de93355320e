"""Scoreline distribution of a match from form and rating.

All of it is array arithmetic inside the row: the only shuffles are those that fit the
parameters, and the long 7 x 7 form is produced only where it is asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import clip, outcome
from pastward.operators import fold_stats
from pastward.operators.decisions import argmax_label
from pastward.operators.ranks import median

# Fixed values of the model.
MAX_GOALS = 6
MIN_LAMBDA, MAX_LAMBDA = 0.05, 5.0
RATING_WEIGHT, RATING_SCALE = 0.10, 400.0
HOME_INPUTS = ("home_xg_home_last5", "home_xg_overall_last5", "away_xga_away_last5", "away_xga_overall_last5")
AWAY_INPUTS = ("away_xg_away_last5", "away_xg_overall_last5", "home_xga_home_last5", "home_xga_overall_last5")
_GROUPS = {
    "avg_home_xg": HOME_INPUTS[:2],
    "avg_away_xg": AWAY_INPUTS[:2],
    "avg_xga": HOME_INPUTS[2:] + AWAY_INPUTS[2:],
}
INPUTS = tuple(sorted(HOME_INPUTS + AWAY_INPUTS))


def fit_parameters(train: DataFrame, by: list[str]) -> DataFrame:
    """Per fold: mean goals, pooled means of the known inputs, exact medians with fallbacks.

    The inputs are stacked to (input, value) rows once, so the eight medians share one pass.
    """
    goals = train.groupBy(*by).agg(F.avg("home_goals").alias("avg_home_goals"), F.avg("away_goals").alias("avg_away_goals"))
    stacked = train.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("value")) for c in INPUTS])).alias("x")
    ).select(*by, "x.*").filter(F.col("value").isNotNull())
    means = stacked.groupBy(*by).agg(*[
        F.avg(F.when(F.col("input").isin(*cols), F.col("value"))).alias(f"_{name}") for name, cols in _GROUPS.items()
    ])
    medians = median(stacked, [*by, "input"], "value").groupBy(*by).agg(*[
        F.max(F.when(F.col("input") == c, F.col("median"))).alias(f"_med_{c}") for c in INPUTS
    ])
    return _with_fallbacks(goals.join(means, by, "left").join(medians, by, "left"), by)


def _with_fallbacks(out: DataFrame, by: list[str]) -> DataFrame:
    """Means of goals stand in for unknown means of inputs, and those for unknown medians."""
    both = (F.col("avg_home_goals") + F.col("avg_away_goals")) / 2
    out = out.withColumns({
        "avg_home_xg": F.coalesce("_avg_home_xg", "avg_home_goals"),
        "avg_away_xg": F.coalesce("_avg_away_xg", "avg_away_goals"),
        "avg_xga": F.coalesce(F.col("_avg_xga"), both),
    })
    fallback = {c: name for name, cols in _GROUPS.items() for c in cols}
    return out.select(
        *by, "avg_home_goals", "avg_away_goals", *_GROUPS,
        *[F.coalesce(f"_med_{c}", fallback[c]).alias(f"median_{c}") for c in INPUTS],
    )


def fit_walk_forward(rows: DataFrame, rank: str, min_train: int = 2) -> DataFrame:
    """The parameters of every fold at once, each from all seasons before its validation season.

    ``rank`` is the place of a row's season in time, from 1. Means are running sums of sums per season, medians come from merged
    histograms per season; no row is copied for a fold.
    """
    sums = {"n": F.count("*"), "home_n": F.count("home_goals"), "away_n": F.count("away_goals"), "home": F.sum("home_goals"), "away": F.sum("away_goals")}
    for name, cols in _GROUPS.items():
        sums[f"{name}_sum"] = sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in cols), F.lit(0.0))
        sums[f"{name}_n"] = sum((F.count(c) for c in cols), F.lit(0))
    total = fold_stats.running_sums(rows, rank, sums, min_train)
    means = total.select(
        "fold", F.try_divide("home", "home_n").alias("avg_home_goals"), F.try_divide("away", "away_n").alias("avg_away_goals"),
        *[F.try_divide(f"{name}_sum", f"{name}_n").alias(f"_{name}") for name in _GROUPS])
    medians = fold_stats.medians(rows, rank, list(INPUTS), min_train)
    return _with_fallbacks(means.join(medians.withColumnsRenamed({f"median_{c}": f"_med_{c}" for c in INPUTS}), "fold", "left"), ["fold"])


def with_lambdas(df: DataFrame, rating_gap: str) -> DataFrame:
    """Expected goals of both sides from filled inputs and the rating gap."""

    def base(inputs) -> Column:
        return sum((F.coalesce(c, f"median_{c}") for c in inputs), F.lit(0.0)) / len(inputs)

    tilt = RATING_WEIGHT * F.coalesce(F.col(rating_gap), F.lit(0.0)) / RATING_SCALE
    return df.withColumns({
        "home_lambda": clip(base(HOME_INPUTS) * F.exp(tilt), MIN_LAMBDA, MAX_LAMBDA),
        "away_lambda": clip(base(AWAY_INPUTS) * F.exp(-tilt), MIN_LAMBDA, MAX_LAMBDA),
    })


def _pmf(rate: str) -> Column:
    raw = [F.exp(-F.col(rate)) * F.pow(F.col(rate), F.lit(float(k))) / math.factorial(k) for k in range(MAX_GOALS + 1)]
    return F.array(*raw)


def with_pmf(df: DataFrame) -> DataFrame:
    """Goal distributions 0..6 of both sides, cut off and scaled to 1."""
    out = df.withColumns({"home_pmf": _pmf("home_lambda"), "away_pmf": _pmf("away_lambda")})

    def scaled(c: str) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        return F.transform(c, lambda x: x / total)

    return out.withColumns({"home_pmf": scaled("home_pmf"), "away_pmf": scaled("away_pmf")})


def score_grid(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: one row per match and scoreline."""
    goals = F.sequence(F.lit(0), F.lit(MAX_GOALS))
    rows = df.select(*keep, "home_pmf", "away_pmf", F.explode(goals).alias("home_score"))
    rows = rows.select("*", F.explode(goals).alias("away_score"))
    p = F.element_at("home_pmf", F.col("home_score") + 1) * F.element_at("away_pmf", F.col("away_score") + 1)
    return rows.select(*keep, "home_score", "away_score", p.alias("p"))


def with_outcomes(df: DataFrame) -> DataFrame:
    """Probability of home win, draw and away win."""
    h, a = (lambda i: F.col("home_pmf")[i]), (lambda j: F.col("away_pmf")[j])
    goals = range(MAX_GOALS + 1)

    def mass(keep) -> Column:
        return sum((h(i) * a(j) for i in goals for j in goals if keep(i, j)), F.lit(0.0))

    out = df.withColumns({
        "_h": mass(lambda i, j: i > j), "_d": mass(lambda i, j: i == j), "_a": mass(lambda i, j: i < j),
    })
    total = F.col("_h") + F.col("_d") + F.col("_a")
    return out.withColumns({
        "p_home": F.col("_h") / total, "p_draw": F.col("_d") / total, "p_away": F.col("_a") / total,
    }).drop("_h", "_d", "_a")


def _cells() -> Column:
    """All scorelines of a row as (p, cell), so that of equal ones the higher score pair is the greater."""
    return F.flatten(F.transform("home_pmf", lambda h, i: F.transform(
        "away_pmf", lambda a, j: F.struct(F.round(h * a, 9).alias("p"), (i * (MAX_GOALS + 1) + j).alias("cell"))
    )))


def top_scorelines(n: int = 5) -> Column:
    """The n likeliest scorelines of a row; ties go to the higher score pair."""
    best = F.slice(F.sort_array(_cells(), asc=False), 1, n)
    return F.transform(best, lambda c: F.struct(
        F.floor(c["cell"] / (MAX_GOALS + 1)).cast("int").alias("home_score"),
        (c["cell"] % (MAX_GOALS + 1)).cast("int").alias("away_score"),
        c["p"].alias("p"),
    ))


def predict(valid: DataFrame, parameters: DataFrame, by: list[str], rating_gap: str) -> DataFrame:
    """Prediction frame of a fold: rates, outcome probabilities, label, likeliest score.

    The parameters hold one row per fold, a handful by construction.
    """
    rows = valid.join(F.broadcast(parameters), by)
    out = with_outcomes(with_pmf(with_lambdas(rows, rating_gap)))
    out = out.withColumns({"top_scorelines": top_scorelines(), "_best": F.array_max(_cells())["cell"]})
    return out.withColumns({
        "predicted_result": argmax_label(),
        "predicted_home_goals": F.floor(F.col("_best") / (MAX_GOALS + 1)).cast("int"),
        "predicted_away_goals": (F.col("_best") % (MAX_GOALS + 1)).cast("int"),
        "result": outcome("home_goals", "away_goals"),
    }).drop("_best")


def goal_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Errors of the predicted score."""
    dh = F.col("home_goals") - F.col("predicted_home_goals")
    da = F.col("away_goals") - F.col("predicted_away_goals")
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(dh)).alias("home_goals_mae"),
        F.avg(F.abs(da)).alias("away_goals_mae"),
        F.avg(F.abs(dh + da)).alias("total_goals_mae"),
        F.avg(((dh == 0) & (da == 0)).cast("double")).alias("exact_score_accuracy"),
    )


def draw_diagnostics(df: DataFrame, by: list[str]) -> DataFrame:
    """Level and spread of the draw probability."""
    p = F.col("p_draw")
    middle = median(df, by, "p_draw").withColumnRenamed("median", "median_draw_proba")
    return df.groupBy(*by).agg(
        F.avg(p).alias("mean_draw_proba"),
        F.max(p).alias("max_draw_proba"),
        F.count_if((p > F.col("p_home")) & (p >= F.col("p_away"))).alias("draw_highest_count"),
        F.count_if(p >= 0.25).alias("draw_proba_ge_025_count"),
        F.count_if(p >= 0.30).alias("draw_proba_ge_030_count"),
        F.avg((F.col("result") == "D").cast("double")).alias("actual_draw_rate"),
    ).join(middle, by)


def sanity_rules(tolerance: float = 1e-9) -> dict[str, str]:
    """Bounds every prediction row must meet."""
    cells = "aggregate(home_pmf, 0D, (s, x) -> s + x) * aggregate(away_pmf, 0D, (s, x) -> s + x)"
    return {
        "home_lambda_in_bounds": f"home_lambda BETWEEN {MIN_LAMBDA} AND {MAX_LAMBDA}",
        "away_lambda_in_bounds": f"away_lambda BETWEEN {MIN_LAMBDA} AND {MAX_LAMBDA}",
        "grid_sums_to_one": f"abs({cells} - 1) <= {tolerance}",
        "outcomes_in_unit_interval": f"least(p_home, p_draw, p_away) >= -{tolerance} AND greatest(p_home, p_draw, p_away) <= 1 + {tolerance}",
        "outcomes_sum_to_one": f"abs(p_home + p_draw + p_away - 1) <= {tolerance}",
    }
