"""Positions and ranks over large groups, computed in two levels.

A window over a whole group is one task. Here the group is first counted per bucket
(a coarse function of the sort key), the counts are summed along the few buckets, and
the fine order is worked out inside each bucket only.

Buckets of values come from the data: a mergeable quantile sketch of the distinct values of each scope gives
``BUCKETS - 1`` splitters, so that buckets hold about as many distinct values each, however the values lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 256
_STEP = 16


def _bounds(df: DataFrame, scope: list[str], value: str, buckets: int) -> DataFrame:
    shares = [k / buckets for k in range(1, buckets)]
    bounds = df.groupBy(*scope).agg(F.percentile_approx(value, shares, 8 * buckets).alias("_bounds"))
    return bounds.withColumn("_coarse", F.filter("_bounds", lambda _, i: i % _STEP == _STEP - 1))


def bucketed(df: DataFrame, scope: list[str], value: str, name: str = "_b", buckets: int = BUCKETS) -> DataFrame:
    """Adds the bucket of each known value among the splitters of its scope; values should be combined, so that they repeat rarely.

    The bucket is the number of splitters below the value: the coarse ones first, then those between two coarse ones.
    """
    known = df.filter(F.col(value).isNotNull())
    bounds = _bounds(known, scope, value, buckets)
    joined = _null_safe(known, bounds, scope) if scope else known.join(F.broadcast(bounds))  # one row
    coarse = F.size(F.filter("_coarse", lambda x: x < F.col(value)))
    fine = F.size(F.filter(F.slice("_bounds", F.col("_c") * _STEP + 1, F.lit(_STEP)), lambda x: x < F.col(value)))
    return joined.withColumn("_c", coarse).withColumn(name, F.col("_c") * _STEP + fine).drop("_bounds", "_coarse", "_c")


def _offsets(df: DataFrame, scope: list[str], bucket: str, weight) -> DataFrame:
    counts = df.groupBy(*scope, bucket).agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*scope).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*scope)
    return counts.select(
        *scope,
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("scope_rows"),
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return left.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])


def positions(df: DataFrame, scope: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds ``position`` (0-based, in the order (bucket, *order)) and ``scope_rows``."""
    inside = Window.partitionBy(*scope, bucket).orderBy(*order)
    joined = _null_safe(df, _offsets(df, scope, bucket, F.lit(1)), [*scope, bucket])
    return joined.withColumn("position", F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def running_totals(df: DataFrame, scope: list[str], bucket: str, order: list[str], value, name: str) -> DataFrame:
    """Adds the running total up to and including each row, and ``<name>_before``: the total of earlier buckets."""
    offsets = _offsets(df, scope, bucket, value).select(*scope, bucket, F.col("_before").alias(f"{name}_before"))
    inside = Window.partitionBy(*scope, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _null_safe(df, offsets, [*scope, bucket]).withColumn(name, F.col(f"{name}_before") + F.sum(value).over(inside))


def value_ranks(df: DataFrame, scope: list[str], value: str, bucket=None) -> DataFrame:
    """Distinct values with their count and the ranks (1-based) of their first and last row.

    Rows are combined per value before any shuffle. Buckets are those of ``bucketed``, or a column
    expression that does not decrease with the value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*scope, F.col(value)).agg(F.count("*").alias("rows"))
    counts = bucketed(counts, scope, value) if bucket is None else counts.withColumn("_b", bucket)
    offsets = _offsets(counts, scope, "_b", F.col("rows"))
    inside = Window.partitionBy(*scope, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _null_safe(counts, offsets, [*scope, "_b"]).withColumn(
        "last_rank", F.col("_before") + F.sum("rows").over(inside)
    )
    return ranked.withColumn("first_rank", F.col("last_rank") - F.col("rows") + 1).drop("_b", "_before")


def median(df: DataFrame, scope: list[str], value: str, bucket=None) -> DataFrame:
    """Exact median per scope: mean of the middle value or values."""
    ranked = value_ranks(df, scope, value, bucket)
    low, high = F.floor((F.col("scope_rows") + 1) / 2), F.ceil((F.col("scope_rows") + 1) / 2)

    def at(rank):
        return F.max(F.when((F.col("first_rank") <= rank) & (rank <= F.col("last_rank")), F.col(value)))

    return ranked.groupBy(*scope).agg(((at(low) + at(high)) / 2).alias("median"))


def average_rank(df: DataFrame, scope: list[str], value: str, bucket, name: str) -> DataFrame:
    """Rank of every distinct value, rows of equal value sharing their mean rank, and its distance from the middle rank."""
    rank = (F.col("first_rank") + F.col("last_rank")) / 2
    return value_ranks(df, scope, value, bucket).select(
        *scope, value, rank.alias(name), (rank - (F.col("scope_rows") + 1) / 2).alias(f"{name}_centred")
    )


def spearman(df: DataFrame, left: str, right: str, left_bucket=None, right_bucket=None) -> DataFrame:
    """Rank correlation with shared ranks for ties; 0 when a side is constant.

    Works on distinct value pairs with weights, so repeated values cost nothing.
    """
    rows = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right)
    pairs = rows.groupBy(left, right).agg(F.count("*").alias("w"))
    ranked = pairs.join(average_rank(rows, [], left, left_bucket, "l"), left).join(
        average_rank(rows, [], right, right_bucket, "r"), right
    )
    w, a, b = F.col("w"), F.col("l_centred"), F.col("r_centred")
    total = ranked.agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return total.select(
        F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("spearman")
    )
