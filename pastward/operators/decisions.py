"""From class probabilities to labels, and the choice of decision parameters on a grid.

Grids are expanded row by row inside the scan task and combined before the shuffle, so
what moves is one line of counters per candidate and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import DRAW, HOME, AWAY, LABELS, zero_if_undefined

PROBS = ("p_home", "p_draw", "p_away")

# Fixed values of the decision rules and their grids.
DOMINANT = 0.50
OVERLAY_GRID = (0.20, 0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34)
RULE_THRESHOLDS = (0.20, 0.22, 0.24, 0.26, 0.28, 0.30)
RULE_MARGINS = (0.00, 0.03, 0.06, 0.09, 0.12)
TEMPERATURES = (0.75, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0, 2.5, 3.0)
BLENDS = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25)
OVERLAY_ACCURACY_LOSS, RULE_ACCURACY_LOSS = 0.01, 0.03


def _probs(probs) -> list[Column]:
    return [F.col(p) if isinstance(p, str) else p for p in probs]


def normalized(probs=PROBS) -> list[Column]:
    """Probabilities divided by their sum; NULL where the sum is not positive."""
    h, d, a = _probs(probs)
    total = h + d + a
    return [F.when(total > 0, p / total) for p in (h, d, a)]


def argmax_label(probs=PROBS) -> Column:
    """Label of the largest probability; ties go to the first in H, D, A."""
    h, d, a = _probs(probs)
    return F.when((h >= d) & (h >= a), HOME).when(d >= a, DRAW).otherwise(AWAY)


def draw_is_second(probs=PROBS) -> Column:
    """Draw holds the second place, ties in label order."""
    h, d, a = _probs(probs)
    return (h >= d).cast("int") + (a > d).cast("int") == 1


def overlay_applies(threshold, probs=PROBS, dominant: float = DOMINANT) -> Column:
    h, d, a = _probs(probs)
    return (d >= threshold) & draw_is_second(probs) & (F.greatest(h, d, a) < dominant)


def overlay_label(threshold, probs=PROBS, dominant: float = DOMINANT) -> Column:
    """Draw where it is a strong enough second behind a weak favourite, else the argmax."""
    return F.when(overlay_applies(threshold, probs, dominant), DRAW).otherwise(argmax_label(probs))


def draw_rule_label(threshold, margin, probs=PROBS) -> Column:
    """Draw where it is likely enough and close enough to the best other label."""
    h, d, a = _probs(probs)
    close = (d >= threshold) & (F.greatest(h, a) - d <= margin)
    return F.when(close, DRAW).otherwise(argmax_label(probs))


def tempered(temperature, probs=PROBS) -> list[Column]:
    """Sharpen (below 1) or flatten (above 1) the probabilities."""
    powers = [F.exp(F.log(F.greatest(p, F.lit(1e-12))) / temperature) for p in normalized(probs)]
    total = powers[0] + powers[1] + powers[2]
    return [p / total for p in powers]


def blended(alpha, prior, probs=PROBS) -> list[Column]:
    """Mix with class shares."""
    return [(1.0 - alpha) * p + alpha * q for p, q in zip(_probs(probs), prior)]


def _grid(name_values: dict[str, tuple]) -> Column:
    names = list(name_values)
    combos = [()]
    for name in names:
        combos = [(*c, v) for c in combos for v in name_values[name]]
    return F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, c)]) for c in combos]))


def _draw_counts(label: Column, actual: Column) -> dict[str, Column]:
    return {
        "correct": F.count_if(label == actual),
        "tp": F.count_if((label == DRAW) & (actual == DRAW)),
        "predicted_draws": F.count_if(label == DRAW),
        "actual_draws": F.count_if(actual == DRAW),
    }


def _draw_scores() -> dict[str, Column]:
    precision = zero_if_undefined("tp", "predicted_draws")
    recall = zero_if_undefined("tp", "actual_draws")
    return {
        "accuracy": F.col("correct") / F.col("rows"),
        "draw_precision": precision,
        "draw_recall": recall,
        "draw_f1": zero_if_undefined(2 * precision * recall, precision + recall),
    }


def _candidates(df: DataFrame, by: list[str], grid: dict[str, tuple], label, actual: str) -> DataFrame:
    names = list(grid)
    base = argmax_label()
    rows = df.select(*by, actual, *[p.alias(n) for p, n in zip(normalized(), PROBS)])
    rows = rows.select("*", base.alias("_base"), _grid(grid).alias("g")).select("*", "g.*").drop("g")
    picked = rows.withColumn("_label", label(*[F.col(n) for n in names]))
    counts = picked.groupBy(*by, *names).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_base") == F.col(actual)).alias("base_correct"),
        F.count_if((F.col("_label") == DRAW) & (F.col("_base") != DRAW)).alias("changed_to_draw"),
        *[v.alias(k) for k, v in _draw_counts(F.col("_label"), F.col(actual)).items()],
    )
    scored = counts.withColumns(_draw_scores()).withColumn("argmax_accuracy", F.col("base_correct") / F.col("rows"))
    return scored.drop("base_correct", "correct", "tp", "actual_draws")


def overlay_candidates(df: DataFrame, actual: str, by: list[str] = (), grid: tuple = OVERLAY_GRID) -> DataFrame:
    """Scores of every overlay threshold; those that lose too much accuracy are marked."""
    out = _candidates(df, list(by), {"draw_threshold": grid}, lambda t: overlay_label(t), actual)
    return out.withColumn("rejected", F.col("accuracy") < F.col("argmax_accuracy") - OVERLAY_ACCURACY_LOSS)


def _best(candidates: DataFrame, by: list[str], key: list[Column]) -> DataFrame:
    rest = [c for c in candidates.columns if c not in by]
    best = candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*key)).alias("b"))
    return best.select(*by, "b.*")


def select_overlay_threshold(df: DataFrame, actual: str, by: list[str] = (), grid: tuple = OVERLAY_GRID) -> DataFrame:
    """Best threshold: draw F1, then accuracy, then fewest changed labels, then the larger threshold."""
    kept = overlay_candidates(df, actual, by, grid).filter(~F.col("rejected")).drop("rejected")
    key = [F.col("draw_f1"), F.col("accuracy"), -F.col("changed_to_draw"), F.col("draw_threshold")]
    return _best(kept, list(by), key)


def select_draw_rule(df: DataFrame, actual: str, by: list[str] = ()) -> DataFrame:
    """Best (threshold, margin) on the grid among those that keep enough accuracy."""
    grid = {"draw_threshold": RULE_THRESHOLDS, "draw_margin": RULE_MARGINS}
    kept = _candidates(df, list(by), grid, lambda t, m: draw_rule_label(t, m), actual).filter(
        F.col("accuracy") >= F.col("argmax_accuracy") - RULE_ACCURACY_LOSS
    )
    key = [
        F.col("draw_f1"), F.col("accuracy"), F.col("draw_precision"), -F.col("predicted_draws"),
        -F.col("draw_threshold"), -F.col("draw_margin"),
    ]
    return _best(kept, list(by), key)


def class_shares(df: DataFrame, actual: str, by: list[str] = ()) -> DataFrame:
    """Observed share of each class."""
    return df.groupBy(*by).agg(*[
        (F.count_if(F.col(actual) == label) / F.count("*")).alias(f"prior_{name}")
        for label, name in zip(LABELS, ("home", "draw", "away"))
    ])


def calibration_candidates(df: DataFrame, actual: str, by: list[str] = ()) -> DataFrame:
    """Log loss and Brier score of every (temperature, blend), per group."""
    prior = [F.col(f"prior_{n}") for n in ("home", "draw", "away")]
    shares = F.broadcast(class_shares(df, actual, by))  # one row, or one per group: a fold, a season
    rows = df.select(*by, actual, *[p.alias(n) for p, n in zip(normalized(), PROBS)])
    rows = rows.join(shares, list(by)) if by else rows.join(shares)
    # The temperature part is worked out once per (row, temperature), the blends follow from it.
    rows = rows.select("*", _grid({"temperature": TEMPERATURES}).alias("g")).select("*", "g.temperature").drop("g")
    rows = rows.select(
        *by, actual, "temperature",
        *[f"prior_{n}" for n in ("home", "draw", "away")],
        *[p.alias(n) for p, n in zip(tempered(F.col("temperature")), PROBS)],
    )
    rows = rows.select("*", _grid({"alpha": BLENDS}).alias("g")).select("*", "g.alpha").drop("g")
    final = blended(F.col("alpha"), prior)
    hit = F.when(F.col(actual) == HOME, final[0]).when(F.col(actual) == DRAW, final[1]).otherwise(final[2])
    square = sum(
        ((p - (F.col(actual) == label).cast("double")) * (p - (F.col(actual) == label).cast("double")) for p, label in zip(final, LABELS)),
        F.lit(0.0),
    )
    return rows.groupBy(*by, "temperature", "alpha").agg(
        F.avg(-F.log(F.greatest(hit, F.lit(1e-15)))).alias("log_loss"), F.avg(square).alias("brier_score")
    )


def select_calibration(df: DataFrame, actual: str, by: list[str] = ()) -> DataFrame:
    """Best (temperature, blend) per group: log loss, Brier score, nearness to 1, smaller blend.

    Losses count as equal when they agree to twelve places, so that the order of additions decides nothing.
    """
    key = F.struct(F.round("log_loss", 12), F.round("brier_score", 12), F.abs(F.col("temperature") - 1.0), "alpha")
    best = calibration_candidates(df, actual, by)
    rest = [c for c in best.columns if c not in by]
    return best.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("b")).select(*by, "b.*")


def prediction_rows(df: DataFrame, threshold: float, dominant: float = DOMINANT) -> DataFrame:
    """Serving columns: labels, confidence, draw flags. The overlay counts as applied only where it changes the label."""
    scaled = df.withColumns(dict(zip(PROBS, normalized())))
    changed = (argmax_label() != DRAW) & overlay_applies(threshold, PROBS, dominant)
    return scaled.withColumns({
        "argmax_prediction": argmax_label(),
        "overlay_prediction": F.when(changed, DRAW).otherwise(argmax_label()),
        "draw_overlay_applied": changed,
        "confidence": F.greatest(*PROBS),
    }).withColumn(
        "draw_risk_flag", (F.col("overlay_prediction") == DRAW) | (F.col("p_draw") >= threshold)
    )
