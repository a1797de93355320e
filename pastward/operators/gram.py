"""Ridge regression for all expanding folds from one scan.

What least squares needs is additive: counts, sums and products of columns. They are added up once per season; a fold's are running sums
along the seasons. Missing features are filled with a fold's own medians after the fact: beside x (0 where missing) the
products of the missing marks are added up too, and filling is a linear map of both. So every fold has its own imputation although no row is read
twice. What is solved per fold is one small system; a fold's coefficients are a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators import fold_stats

ALPHA = 10.0


def _columns(features: list[str], target: str) -> list[tuple[str, Column]]:
    """Named columns whose products are added up: values, missing marks, one, target."""
    known = [(f"x_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in features]
    missing = [(f"m_{c}", F.col(c).isNull().cast("double")) for c in features]
    return [*known, *missing, ("one", F.lit(1.0)), ("y", F.col(target).cast("double"))]


def gram_names(features: list[str]) -> list[tuple[str, str]]:
    names = [f"x_{c}" for c in features] + [f"m_{c}" for c in features] + ["one", "y"]
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def fold_grams(rows: DataFrame, rank: str, features: list[str], target: str, min_train: int = 2) -> DataFrame:
    """(fold, one column <a>__<b> per pair): sums of products over the training rows of each fold; rows without target don't count.

    With p features these are (2 p + 2) (2 p + 3) / 2 sums in one aggregate.
    """
    values = dict(_columns(features, target))
    sums = {f"{a}__{b}": F.sum(values[a] * values[b]) for a, b in gram_names(features)}
    return fold_stats.running_sums(rows.filter(F.col(target).isNotNull()), rank, sums, min_train)


def gram_entries(grams: DataFrame, features: list[str]) -> DataFrame:
    """Long form: (fold, left, right, total)."""
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}__{b}").alias("total")) for a, b in gram_names(features)]
    return grams.select("fold", F.explode(F.array(*cells)).alias("c")).select("fold", "c.*")


def solve_ridge(grams: DataFrame, medians: DataFrame, features: list[str], alpha: float = ALPHA) -> DataFrame:
    """(fold, intercept, <feature> …, median_<feature> …, residual): coefficients of the filled features, intercept not penalised.

    ``medians`` has (fold, median_<feature> …); a feature that no training row of a fold knows is filled with 0. ``residual`` is the largest absolute
    entry of the penalised normal equations, divided by the number of rows. One task solves a few folds, each from some hundred numbers.
    """
    p, names = len(features), gram_names(features)
    filled = [F.coalesce(F.col(f"median_{c}"), F.lit(0.0)).alias(f"median_{c}") for c in features]
    rows = grams.join(medians, "fold", "left").select("fold", F.array(*[F.col(f"`{a}__{b}`") for a, b in names]).alias("gram"), F.array(*filled).alias("medians"))

    def run(frames):
        import numpy as np
        import pandas as pd

        at = np.triu_indices(2 * p + 2)
        for frame in frames:
            out = []
            for fold, gram, middle in zip(frame["fold"], frame["gram"], frame["medians"], strict=True):
                full = np.zeros((2 * p + 2, 2 * p + 2))
                full[at] = gram
                full = full + np.triu(full, 1).T
                fill = np.zeros((p + 2, 2 * p + 2))
                fill[:p, :p], fill[:p, p:2 * p], fill[p:, 2 * p:] = np.eye(p), np.diag(middle), np.eye(2)
                full = fill @ full @ fill.T
                n, sums, total = full[p, p], full[:p, p], full[p, p + 1]
                left = full[:p, :p] - np.outer(sums, sums) / n
                right = full[:p, p + 1] - sums * total / n
                slope = np.linalg.solve(left + alpha * np.eye(p), right)
                intercept = (total - sums @ slope) / n
                gap = np.append(full[:p, p + 1] - full[:p, :p] @ slope - sums * intercept - alpha * slope, total - sums @ slope - n * intercept)
                out.append([int(fold), float(intercept), *map(float, slope), *map(float, middle), float(np.abs(gap).max() / n)])
            yield pd.DataFrame(out, columns=["fold", "intercept", *features, *[f"median_{c}" for c in features], "residual"])

    schema = ", ".join(["fold int", "intercept double", *[f"`{c}` double" for c in features], *[f"`median_{c}` double" for c in features], "residual double"])
    return rows.mapInPandas(run, schema)


def walk_forward_ridge(rows: DataFrame, rank: str, features: list[str], target: str, min_train: int = 2, alpha: float = ALPHA) -> DataFrame:
    """The model of every fold, one row each: medians and coefficients from the seasons before its validation season."""
    known = rows.filter(F.col(target).isNotNull())
    medians = fold_stats.medians(known, rank, features, min_train)
    return solve_ridge(fold_grams(known, rank, features, target, min_train), medians, features, alpha)


def predict(rows: DataFrame, models: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    """Rows with ``fold`` get the prediction of their fold's model; there is one model per fold."""
    own = models.select("fold", F.struct("intercept", *features, *[f"median_{c}" for c in features]).alias("_model"))
    joined = rows.join(F.broadcast(own), "fold")  # one row per fold
    total = F.col("_model.intercept")
    for c in features:
        total = total + F.col(f"_model.{c}") * F.coalesce(F.col(c).cast("double"), F.col(f"_model.median_{c}"))
    return joined.withColumn(name, total).drop("_model")
