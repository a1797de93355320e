"""Scores of predictions. Every table of scores comes from one aggregation pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import DRAW, LABELS, zero_if_undefined
from pastward.operators.decisions import PROBS, argmax_label, normalized
from pastward.operators.reshape import struct_rows

_NAMES = dict(zip(LABELS, ("home", "draw", "away")))


def individual_log_loss(actual, probs=PROBS) -> Column:
    """Log loss of one row of normalised probabilities, kept above 1e-15."""
    a = F.col(actual) if isinstance(actual, str) else actual
    hit = reduce(lambda acc, pair: acc.when(a == pair[0], F.col(pair[1])), zip(LABELS, probs), F.when(F.lit(False), 0.0))
    return -F.log(F.greatest(F.when(a.isin(*LABELS), hit), F.when(a.isin(*LABELS), 1e-15)))


def individual_brier(actual, probs=PROBS) -> Column:
    a = F.col(actual) if isinstance(actual, str) else actual
    gaps = [F.col(p) - (a == label).cast("double") for p, label in zip(probs, LABELS)]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def with_scores(df: DataFrame, actual: str) -> DataFrame:
    """Normalises the probabilities and adds argmax label, correctness and the loss of each row.

    Normalising comes first, as columns of their own, so that later expressions stay small.
    """
    return df.withColumns(dict(zip(PROBS, normalized()))).withColumns({
        "argmax_prediction": argmax_label(),
        "row_log_loss": individual_log_loss(actual),
        "row_brier": individual_brier(actual),
    }).withColumn("argmax_correct", F.col("argmax_prediction") == F.col(actual))


def class_scores(predicted: str, actual: str, label: str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of one class, 0 where undefined."""
    p, a = F.col(predicted) == label, F.col(actual) == label
    hits = F.count_if(p & a)
    precision, recall = zero_if_undefined(hits, F.count_if(p)), zero_if_undefined(hits, F.count_if(a))
    return precision, recall, zero_if_undefined(2 * precision * recall, precision + recall)


def evaluate(df: DataFrame, actual: str, by: list[str] = (), predicted: str | None = None) -> DataFrame:
    """Accuracy, log loss, Brier score and draw scores per group."""
    scored = with_scores(df, actual)
    label = predicted or "argmax_prediction"
    precision, recall, f1 = class_scores(label, actual, DRAW)
    return scored.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg((F.col(label) == F.col(actual)).cast("double")).alias("accuracy"),
        F.avg("row_log_loss").alias("log_loss"),
        F.avg("row_brier").alias("brier_score"),
        recall.alias("draw_recall"),
        precision.alias("draw_precision"),
        f1.alias("draw_f1"),
        *[F.count_if(F.col(label) == x).alias(f"pred_{x}") for x in LABELS],
        *[F.avg(p).alias(f"mean_prob_{x}") for x, p in zip(LABELS, PROBS)],
    )


def class_table(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, absent classes included."""
    aggregates = []
    for label in LABELS:
        precision, recall, f1 = class_scores(predicted, actual, label)
        aggregates.append(F.struct(
            F.lit(label).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            F.count_if(F.col(actual) == label).alias("support"),
        ).alias(label))
    return struct_rows(df.agg(*aggregates), [F.col(x) for x in LABELS])


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """All nine cells, zeros included, one row per actual class."""
    cells = [
        F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}{p}") for a in LABELS for p in LABELS
    ]
    rows = [
        F.struct(F.lit(a).alias("actual"), *[F.col(f"{a}{p}").alias(f"pred_{p}") for p in LABELS]) for a in LABELS
    ]
    return struct_rows(df.agg(*cells), rows)


def label_counts(df: DataFrame, labels: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Distribution of several label columns side by side."""
    return df.groupBy(*by).agg(*[
        F.count_if(F.col(col) == x).alias(f"{name}_{x}") for name, col in labels.items() for x in LABELS
    ])


def health_row(df: DataFrame, actual: str, by: list[str] = ()) -> DataFrame:
    """Monitoring row of scored predictions with normalised probabilities; notes a small sample."""
    total = F.count("*")
    out = {"prediction_count": total, "scored_count": F.count(actual)}
    for mode in ("argmax", "overlay"):
        out[f"accuracy_{mode}"] = F.avg((F.col(f"{mode}_prediction") == F.col(actual)).cast("double"))
    out |= {"log_loss": F.avg(individual_log_loss(actual)), "brier": F.avg(individual_brier(actual))}
    for mode in ("argmax", "overlay"):
        precision, recall, f1 = class_scores(f"{mode}_prediction", actual, DRAW)
        out |= {f"draw_recall_{mode}": recall, f"draw_precision_{mode}": precision, f"draw_f1_{mode}": f1}
    for x in LABELS:
        out[f"{_NAMES[x]}_pred_rate_argmax"] = F.count_if(F.col("argmax_prediction") == x) / total
    for x in LABELS:
        out[f"{_NAMES[x]}_actual_rate"] = F.count_if(F.col(actual) == x) / total
    out["notes"] = F.when(total < 5, "LOW_SAMPLE_SIZE")
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def regression_scores(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """MAE, RMSE and R2; R2 over the rows where both values are known."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    gap = y - p
    both = F.when(gap.isNotNull(), y)
    spread = F.var_pop(both) * F.count(both)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1 - F.try_divide(F.sum(gap * gap), spread)).alias("r2"),
    )


METRICS = ("accuracy", "log_loss", "brier_score", "draw_recall", "draw_precision", "draw_f1")


def leaderboard(results: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """Mean and sample deviation per model over its folds; one fold has deviation 0."""
    return results.groupBy(model).agg(
        F.countDistinct(fold).alias("folds"),
        *[F.avg(m).alias(m) for m in METRICS],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in METRICS],
        *[F.sum(f"pred_{x}").alias(f"pred_{x}") for x in LABELS],
        *[F.avg(f"mean_prob_{x}").alias(f"mean_prob_{x}") for x in LABELS],
    )


def fold_deltas(results: DataFrame, model: str, base: str, name: str = "model", fold: str = "fold") -> DataFrame:
    """Metric differences of a model against a base model, per fold."""
    a = results.filter(F.col(name) == model).select(fold, *[F.col(m).alias(f"_a_{m}") for m in METRICS])
    b = results.filter(F.col(name) == base).select(fold, *[F.col(m).alias(f"_b_{m}") for m in METRICS])
    return a.join(b, fold).select(fold, *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(f"{m}_delta") for m in METRICS])


def promotion_gate(deltas: DataFrame, gain: float = 0.003, worst: float = 0.005) -> DataFrame:
    """A model is promoted when it gains on average and no fold gets much worse."""
    out = deltas.agg(
        F.avg("log_loss_delta").alias("aggregate_log_loss_delta"),
        F.avg("brier_score_delta").alias("aggregate_brier_delta"),
        F.max("log_loss_delta").alias("max_fold_log_loss_delta"),
    )
    return out.withColumn("passes", (
        (F.col("aggregate_log_loss_delta") <= -gain)
        & (F.col("aggregate_brier_delta") <= -gain)
        & (F.col("max_fold_log_loss_delta") <= worst)
    ))


def draw_rule_gate(deltas: DataFrame, worst_accuracy: float = 0.02) -> DataFrame:
    """A label rule passes when draws get better in every fold, accuracy holds and probabilities are untouched."""
    drop = F.greatest(F.lit(0.0), -F.col("accuracy_delta"))
    still = (F.abs("log_loss_delta") < 1e-12) & (F.abs("brier_score_delta") < 1e-12)
    out = deltas.agg(
        F.bool_and(F.col("draw_f1_delta") > 0).alias("draw_f1_improved"),
        F.bool_and(F.col("draw_recall_delta") > 0).alias("draw_recall_improved"),
        F.max(drop).alias("max_accuracy_drop"),
        F.bool_and(still).alias("probabilities_unchanged"),
    )
    return out.withColumn("passes", (
        F.col("draw_f1_improved") & F.col("draw_recall_improved") & (F.col("max_accuracy_drop") <= worst_accuracy)
        & F.col("probabilities_unchanged")
    ))


def overlay_gates(folds: DataFrame) -> DataFrame:
    """Acceptance gates of the draw overlay over folds with columns ``*_delta``, ``draw_threshold``, ``changed_to_draw`` and ``rows``."""
    out = folds.agg(
        F.bool_and(F.col("draw_f1_delta") >= 0.03).alias("draw_f1_gains_enough"),
        F.bool_and(F.col("draw_recall_delta") > 0).alias("draw_recall_gains"),
        F.bool_and(F.col("accuracy_delta") >= -0.01).alias("accuracy_holds"),
        (F.max("draw_threshold") - F.min("draw_threshold") <= 0.06).alias("threshold_stable"),
        F.bool_and((F.abs("log_loss_delta") < 1e-12) & (F.abs("brier_score_delta") < 1e-12)).alias("probabilities_unchanged"),
        F.bool_and(F.col("changed_to_draw") <= 0.15 * F.col("rows")).alias("changes_bounded"),
    )
    return out.withColumn("accepted", reduce(lambda a, b: a & b, [F.col(c) for c in out.columns]))


def against_baselines(results: DataFrame, baselines: DataFrame, metrics: tuple = ("accuracy", "log_loss", "brier_score")) -> DataFrame:
    """One measured row against a small table of published rows."""
    a = results.select(*[F.col(m).alias(f"_m_{m}") for m in metrics])
    return baselines.join(a).select("baseline", *[(F.col(f"_m_{m}") - F.col(m)).alias(f"{m}_delta") for m in metrics])


def family_decision(holdout: str, cv: str, home_r2: str, away_r2: str) -> Column:
    """Keep or drop a feature family from its metric changes."""
    h, c = F.col(holdout), F.col(cv)
    return (
        F.when((F.col(home_r2) < -0.05) | (F.col(away_r2) < -0.05), "goal_r2_worse")
        .when((h >= 0.01) & (c < -0.03), "cv_dropped")
        .when(F.greatest(h, c) < 0.01, "no_improvement")
        .otherwise("keep")
    )
