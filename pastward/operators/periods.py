"""Player features per period.

Rows are first reduced to one per (player, period), so two events of one period can
never see each other, and the later windows hold at most one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.operators.joins import many_to_one


def period_rollup(df: DataFrame, keys: list[str], sums: dict[str, str], means: dict[str, str]) -> DataFrame:
    """Sums and means per period."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.col(c).cast("double")).alias(name) for name, c in sums.items()],
        *[F.avg(F.col(c).cast("double")).alias(name) for name, c in means.items()],
    )


def period_collapse(
    df: DataFrame, keys: list[str], row_id: str, sums: list[str], firsts: list[str]
) -> DataFrame:
    """One row per period: sums that stay NULL when all parts are NULL, the smallest row
    id, the first known value in row order, and the number of rows."""
    return df.groupBy(*keys).agg(
        F.min(row_id).alias(row_id),
        *[F.sum(c).alias(c) for c in sums],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row_id))).alias(c) for c in firsts],
        F.count(row_id).alias("row_count"),
    )


def lagged(df: DataFrame, entity: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """Values of the previous existing period."""
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumns({name: F.lag(c).over(w) for name, c in cols.items()})


def rolling(df: DataFrame, entity: list[str], order: list[str], features: dict[str, tuple[Column, int]]) -> DataFrame:
    """Aggregates over the n periods before; equal n share one frame."""
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumns({name: agg.over(w.rowsBetween(-n, -1)) for name, (agg, n) in features.items()})


def player_period_features(
    df: DataFrame, player: list[str], period: list[str], lags: dict, features: dict, rollup: DataFrame
) -> DataFrame:
    """Period features joined back to the event rows."""
    shaped = rolling(lagged(rollup, player, period, lags), player, period, features)
    keep = [*player, *period, *lags, *features]
    return many_to_one(df, shaped.select(*keep), [*player, *period])


def prior_only_features(
    df: DataFrame, player: str, season: str, period: str, tiebreak: str, points: str, minutes: str, stats: list[str]
) -> DataFrame:
    """History-only block of a player: recent means, recent sums, running totals, lineage.

    Recent means skip NULLs; recent sums count a NULL as 0 and are NULL only where there
    is no earlier period; running totals start at 0.
    """
    w = Window.partitionBy(player).orderBy(season, period, tiebreak)
    everything = w.rowsBetween(Window.unboundedPreceding, -1)
    in_season = Window.partitionBy(player, season).orderBy(period, tiebreak).rowsBetween(Window.unboundedPreceding, -1)

    def back(n: int):
        return w.rowsBetween(-n, -1)

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    appeared = (F.coalesce(F.col(minutes), F.lit(0)) > 0).cast("double")
    columns = {"prior_points_last1": F.lag(points).over(w)}
    for n in (3, 5, 10):
        columns[f"prior_points_last{n}"] = F.avg(points).over(back(n))
    for n in (3, 5, 10):
        columns[f"prior_minutes_last{n}"] = F.avg(minutes).over(back(n))
    columns["prior_appearances_last5"] = F.sum(appeared).over(back(5))
    for stat in stats:
        columns[f"prior_{stat}_last5"] = F.sum(filled(stat)).over(back(5))
    zero = F.lit(0.0)
    columns["prior_minutes_total"] = F.coalesce(F.sum(filled(minutes)).over(everything), zero)
    columns["prior_periods_played"] = F.coalesce(F.sum(appeared).over(everything), zero)
    columns["_points_total"] = F.coalesce(F.sum(filled(points)).over(everything), zero)
    columns["prior_points_season"] = F.coalesce(F.sum(filled(points)).over(in_season), zero)
    columns |= lineage_columns(w, season, period)
    out = df.withColumns(columns)
    per_90 = F.when(
        F.col("prior_minutes_total") > 0, F.col("_points_total") * 90.0 / F.col("prior_minutes_total")
    )
    return out.withColumn("prior_points_per_90", per_90).drop("_points_total")


def lineage_columns(w, season: str, period: str) -> dict[str, Column]:
    """First and previous period behind a row, and the number of earlier rows."""
    count = F.row_number().over(w) - 1
    return {
        "prior_row_count": count,
        "history_start_season": F.when(count > 0, F.first(season).over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "history_start_period": F.when(count > 0, F.first(period).over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "history_end_season": F.lag(season).over(w),
        "history_end_period": F.lag(period).over(w),
    }


def features_at(
    df: DataFrame, player: str, season: str, period: str, tiebreak: str, target: tuple[int, int], **kwargs
) -> DataFrame:
    """Features of every player as they stand before a target period.

    Only periods before the target feed in; one synthetic row per player stands for the target.
    """
    before = df.filter(F.struct(season, period) < F.struct(F.lit(target[0]), F.lit(target[1])))
    synthetic = before.groupBy(player).agg((F.max(tiebreak) + 1).alias(tiebreak)).select(
        player, F.lit(target[0]).alias(season), F.lit(target[1]).alias(period), tiebreak, F.lit(True).alias("_target")
    )
    rows = before.withColumn("_target", F.lit(False)).unionByName(synthetic, allowMissingColumns=True)
    return (
        prior_only_features(rows, player, season, period, tiebreak, **kwargs)
        .filter("_target")
        .drop("_target", *[c for c in df.columns if c not in {player, season, period}])
    )


def mature_rows(df: DataFrame, count: str, n: int, current: str, stored: str, numeric: list[str]) -> DataFrame:
    """Rows with enough history; the current value replaces the stored one where known."""
    return (
        df.filter(F.col(count) >= n)
        .withColumn(stored, F.coalesce(F.col(current), F.col(stored)))
        .withColumns({c: F.col(c).try_cast("double") for c in numeric})
    )
