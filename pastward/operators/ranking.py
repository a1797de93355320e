"""Quality of a ranking within periods, and top-k reports.

Rows of equal prediction are combined before anything is ordered, and at most k groups
per period survive the ranking, so a period of any size is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.operators.metrics import regression_scores
from pastward.operators.ranks import spearman
from pastward.operators.reshape import struct_rows


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group in a total order; cut before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _discounted_gains(df: DataFrame, period: list[str], score: str, gain: str, ks: tuple, name: str) -> DataFrame:
    """Discounted gain of the first k places for each k, tied rows sharing the mean gain of their places.

    Ranked once, up to the largest k.
    """
    groups = df.groupBy(*period, score).agg(F.count("*").alias("_n"), F.avg(gain).alias("_g"))
    best_first = Window.partitionBy(*period).orderBy(F.col(score).desc())
    first = groups.withColumn("_place", F.row_number().over(best_first)).filter(F.col("_place") <= max(ks))
    end = F.sum("_n").over(best_first.rowsBetween(Window.unboundedPreceding, 0))
    placed = first.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n")).filter(F.col("_start") < max(ks))

    def gain_at(k: int) -> Column:
        places = F.sequence(F.col("_start") + 1, F.least(F.col("_end"), F.lit(k)))
        discount = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        return F.sum(F.when(F.col("_start") < k, F.col("_g") * discount)).alias(f"{name}{k}")

    return placed.groupBy(*period).agg(*[gain_at(k) for k in ks])


def ndcgs(df: DataFrame, period: list[str], target: str, prediction: str, ks: tuple) -> DataFrame:
    """NDCG@k per period for each k, as ``ndcg_at_<k>``. Gains are targets above the period minimum; equal targets give 1."""
    least = df.groupBy(*period).agg(F.min(target).alias("_min"))
    rows = df.select(*period, F.col(target).cast("double").alias("_t"), F.col(prediction).alias("_p")).join(least, period)
    rows = rows.withColumn("_gain", F.col("_t") - F.col("_min"))
    actual = _discounted_gains(rows, period, "_p", "_gain", ks, "_dcg")
    ideal = _discounted_gains(rows, period, "_t", "_gain", ks, "_ideal")
    return actual.join(ideal, period).select(
        *period, *[F.when(F.col(f"_ideal{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_ideal{k}")).otherwise(1.0).alias(f"ndcg_at_{k}") for k in ks]
    )


def ndcg(df: DataFrame, period: list[str], target: str, prediction: str, k: int) -> DataFrame:
    return ndcgs(df, period, target, prediction, (k,)).withColumnRenamed(f"ndcg_at_{k}", "ndcg")


def top_captures(df: DataFrame, period: list[str], target: str, prediction: str, row_id: str, ks: tuple) -> DataFrame:
    """Points of the k best predicted rows as a share of the k best rows, per period, as ``captured_<k>``; NULL where the best have none."""

    def best(by: str, name: str) -> DataFrame:
        rows = top_k(df.select(*dict.fromkeys([*period, target, by, row_id])), period, [F.col(by).desc(), F.col(row_id)], max(ks))
        return rows.groupBy(*period).agg(*[F.sum(F.when(F.col("rank") <= k, F.col(target))).cast("double").alias(f"{name}{k}") for k in ks])

    both = best(target, "_best").join(best(prediction, "_picked"), period)
    return both.select(*period, *[F.when(F.col(f"_best{k}") > 0, F.col(f"_picked{k}") / F.col(f"_best{k}")).alias(f"captured_{k}") for k in ks])


def top_capture(df: DataFrame, period: list[str], target: str, prediction: str, row_id: str, k: int) -> DataFrame:
    rows = top_captures(df, period, target, prediction, row_id, (k,))
    return rows.filter(F.col(f"captured_{k}").isNotNull()).withColumnRenamed(f"captured_{k}", "captured")


def ranking_report(
    df: DataFrame, period: list[str], target: str, prediction: str, row_id: str, player: str,
    ks: tuple = (10, 25, 50), target_bucket: Column | None = None, prediction_bucket: Column | None = None,
) -> DataFrame:
    """Fifteen (metric, value) rows on a prediction column."""
    t, p = F.col(target), F.col(prediction)
    plain = regression_scores(df, target, prediction).select("mae", "rmse")
    moments = df.agg(
        F.avg(p).alias("prediction_mean"), F.stddev_pop(p).alias("prediction_std"), F.avg(t).alias("actual_mean"),
        F.stddev_samp(t).alias("actual_std"), F.count("*").cast("double").alias("validation_rows"),
        F.countDistinct(player).cast("double").alias("validation_players"),
    )
    rank = spearman(df, target, prediction, target_bucket, prediction_bucket)
    gains = ndcgs(df, period, target, prediction, ks).agg(*[F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks])
    captures = top_captures(df, period, target, prediction, row_id, ks).agg(*[F.avg(f"captured_{k}").alias(f"top{k}_points_captured") for k in ks])
    parts = [plain, moments, rank, gains, captures]
    out = None
    for part in parts:
        rows = struct_rows(part, [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in part.columns])
        out = rows if out is None else out.unionByName(rows)
    return out


def choose_candidate(scores: DataFrame, baseline: str) -> DataFrame:
    """Best model among those with a smaller MAE than the baseline: MAE, then NDCG@25. No row when none beats it."""
    limit = scores.filter(F.col("model") == baseline).select(F.col("mae").alias("_limit"))
    better = scores.filter(F.col("model") != baseline).join(limit, F.col("mae") < F.col("_limit"), "inner").drop("_limit")
    return better.orderBy("mae", F.col("ndcg_at_25").desc(), "model").limit(1)
