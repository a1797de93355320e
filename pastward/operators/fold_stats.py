"""Sums and medians of all expanding folds from one scan.

A fold trains on all seasons up to a rank and validates on the next one, so what its training rows add up to is a running sum of
what each season adds up to. That holds for sums, counts and histograms: they are made once per season and merged along the
seasons, and no training row is copied for a fold. Fold 1 trains on the first ``min_train`` seasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.operators.ranks import bucketed
from pastward.sources.tables import materialize


def _folds(first: Column, last: Column) -> Column:
    """The folds that train on a season: none if it is the last one."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _per_fold(seasons: DataFrame, rank: str, min_train: int) -> DataFrame:
    """Sums of single seasons, a row for each fold that trains on them; ``_last`` is the last season's rank."""
    first = F.greatest(F.col(rank) - (min_train - 1), F.lit(1)).cast("int")
    return seasons.withColumn("fold", F.explode(_folds(first, (F.col("_last") - min_train).cast("int"))))


def running_sums(rows: DataFrame, rank: str, sums: dict[str, Column], min_train: int = 2, by: tuple = ()) -> DataFrame:
    """(fold, *by, sums) over the seasons a fold trains on; folds end before the last season.

    ``sums`` are additive aggregates (sum, count). Rows are added up per season (and ``by``) first; only these few sums are handed to
    every later fold.
    """
    last = rows.agg(F.max(rank).alias("_last"))  # one row
    seasons = rows.groupBy(*by, rank).agg(*[c.alias(n) for n, c in sums.items()]).join(F.broadcast(last))
    return _per_fold(seasons, rank, min_train).groupBy("fold", *by).agg(*[F.sum(n).alias(n) for n in sums])


def season_histogram(rows: DataFrame, rank: str, inputs: list[str]) -> DataFrame:
    """(input, value, rank, rows): how often a season has a value. Histograms of more seasons are appended, those of parts added."""
    stacked = rows.select(rank, F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("value")) for c in inputs])).alias("x"))
    known = stacked.select(rank, "x.*").filter(F.col("value").isNotNull())
    return known.groupBy("input", "value", F.col(rank).alias("rank")).agg(F.count("*").alias("rows"))


def histogram_medians(histogram: DataFrame, min_train: int = 2, last_rank: DataFrame | None = None) -> DataFrame:
    """(fold, input, median), exact: the mean of the middle value or values of all training rows of a fold.

    Coarse counts per bucket are merged along the seasons first. They name the one or two buckets in which the middle of a fold lies, and only
    these are looked at value by value.
    """
    last = histogram.agg(F.max("rank").alias("_last")) if last_rank is None else last_rank
    marked = bucketed(histogram, ["input"], "value", "bucket").join(F.broadcast(last))  # one row
    coarse = marked.groupBy("input", "bucket", "rank", "_last").agg(F.sum("rows").alias("rows"))
    coarse = _per_fold(coarse, "rank", min_train).groupBy("fold", "input", "bucket").agg(F.sum("rows").alias("rows"))
    along = Window.partitionBy("fold", "input").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("fold", "input")
    coarse = coarse.select("*", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("before"), F.sum("rows").over(everything).alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)

    def holds(k: Column, start: Column, size: Column) -> Column:
        return (start < k) & (k <= start + size)

    middle = coarse.filter(holds(low, F.col("before"), F.col("rows")) | holds(high, F.col("before"), F.col("rows"))).drop("rows")
    fine = marked.join(middle, ["input", "bucket"]).filter(F.col("rank") <= F.col("fold") + (min_train - 1))
    fine = fine.groupBy("fold", "input", "bucket", "value", "before", "total").agg(F.sum("rows").alias("rows"))
    inside = Window.partitionBy("fold", "input", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("start", F.col("before") + F.coalesce(F.sum("rows").over(inside), F.lit(0)))

    def at(k: Column) -> Column:
        return F.max(F.when(holds(k, F.col("start"), F.col("rows")), F.col("value")))

    return fine.groupBy("fold", "input").agg(((at(low) + at(high)) / 2).alias("median"))


def medians(rows: DataFrame, rank: str, inputs: list[str], min_train: int = 2) -> DataFrame:
    """(fold, median_<input> …): a row for each fold in which any input is known. The histogram is stored once for its several readers."""
    last = rows.agg(F.max(rank).alias("_last"))
    found = histogram_medians(materialize(season_histogram(rows, rank, inputs)), min_train, last)
    return found.groupBy("fold").agg(*[F.max(F.when(F.col("input") == c, F.col("median"))).alias(f"median_{c}") for c in inputs])
