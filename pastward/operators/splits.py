"""Splits that respect time.

Seasons and periods are ranked as small tables of their own and joined to the rows; nothing is read by the driver,
and Spark decides how to join. What a split needs (an earlier season, enough periods) is checked while rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.operators.ranks import positions

_ROLES = "array<struct<fold:int,role:string>>"


def season_table(df: DataFrame, season: str, date: str) -> DataFrame:
    """Seasons with their first date and rows."""
    return df.groupBy(season).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("rows"))


def ranked_seasons(df: DataFrame, season: str, date: str) -> DataFrame:
    """Seasons by first date: (season, season_rank from 1, seasons). One row per season, so one window holds them."""
    everything = Window.orderBy("first_date", season).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seasons = season_table(df.filter(F.col(season).isNotNull()), season, date)
    return seasons.select(
        season, F.row_number().over(Window.orderBy("first_date", season)).alias("season_rank"), F.count("*").over(everything).cast("int").alias("seasons"))


def last_season(df: DataFrame, season: str, date: str) -> DataFrame:
    """The season that begins last, as a table of one row and column."""
    return ranked_seasons(df, season, date).filter("season_rank = seasons").select(season)


def _checked(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    return rows.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def development_split(df: DataFrame, season: str, date: str, holdout=None) -> tuple[DataFrame, DataFrame]:
    """Seasons before the holdout, and the holdout (the last season unless given)."""
    ranks = ranked_seasons(df, season, date)
    chosen = F.col("season_rank") == F.col("seasons") if holdout is None else F.col(season) == F.lit(holdout)
    cut = F.max(F.when(chosen, F.col("season_rank"))).over(Window.orderBy(season).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranks = _checked(ranks.withColumn("_cut", cut), F.col("_cut") > 1, "no development season before the holdout")
    # One column for the place: an equality with the cut would let the optimizer check the rank in its stead.
    rows = df.join(ranks.select(season, F.signum(F.col("season_rank") - F.col("_cut")).alias("_place")), season)
    before, at = rows.filter("_place < 0"), rows.filter("_place = 0")
    return before.select(*df.columns), at.select(*df.columns)


def _between(low: Column, high: Column, shift: int, role: str) -> Column:
    """(fold, role) for the numbers ``low`` to ``high``; fold is the number less ``shift``."""
    numbers = F.transform(F.sequence(low, high), lambda k: F.struct((k - shift).cast("int").alias("fold"), F.lit(role).alias("role")))
    return F.when(low <= high, numbers).otherwise(F.array().cast(_ROLES))


def _with_roles(df: DataFrame, season: str, ranks: DataFrame, roles: Column, enough: Column) -> DataFrame:
    """A row per pair of its season; the pairs are built on the table of seasons."""
    pairs = _checked(ranks, enough, "not enough seasons for one fold").select(season, F.explode(roles).alias("_r")).select(season, "_r.*")
    return df.join(pairs, season).select(*df.columns, "fold", "role")


def walk_forward(df: DataFrame, season: str, date: str, min_train: int = 2, window: int = 1) -> DataFrame:
    """Rows with (fold, role): train on all seasons before the validation window."""
    rank, last = F.col("season_rank"), F.col("seasons") - window
    # A fold is named by the number of its training seasons, less ``min_train`` - 1.
    train = _between(F.greatest(rank, F.lit(min_train)), last, min_train - 1, "train")
    validation = _between(F.greatest(rank - window, F.lit(min_train)), F.least(rank - 1, last), min_train - 1, "validation")
    return _with_roles(df, season, ranked_seasons(df, season, date), F.concat(train, validation), last >= min_train)


def fit_calibrate_validate(df: DataFrame, season: str, date: str) -> DataFrame:
    """Rows with (fold, role): fit on the seasons before the calibration season, which precedes validation."""
    rank, seasons = F.col("season_rank"), F.col("seasons")
    # A fold is named by the rank of its validation season, from the third on.
    fit = _between(F.greatest(rank + 2, F.lit(3)), seasons, 2, "fit")
    calibrate = _between(F.greatest(rank + 1, F.lit(3)), F.least(rank + 1, seasons), 2, "calibrate")
    validate = _between(F.greatest(rank, F.lit(3)), rank, 2, "validate")
    return _with_roles(df, season, ranked_seasons(df, season, date), F.concat(fit, calibrate, validate), seasons >= 3)


def fold_windows(folds: DataFrame, date: str, roles: tuple = ("train", "validation")) -> DataFrame:
    """Date range of each role per fold, and whether the roles follow one another without overlap."""
    out = folds.groupBy("fold").agg(*[
        e for r in roles for e in (
            F.count_if(F.col("role") == r).alias(f"{r}_rows"),
            F.min(F.when(F.col("role") == r, F.col(date))).alias(f"{r}_min"),
            F.max(F.when(F.col("role") == r, F.col(date))).alias(f"{r}_max"),
        )
    ])
    clean = F.lit(True)
    for before, after in zip(roles[:-1], roles[1:]):
        clean = clean & (F.col(f"{before}_max") < F.col(f"{after}_min"))
    return out.withColumn("no_leak", clean)


def period_split(df: DataFrame, period: list[str], fraction: float = 0.8) -> DataFrame:
    """Adds ``part``: complete periods only, the first share of them is train, the rest test."""
    everything = Window.orderBy(*period).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = df.select(*period).dropna().distinct().select(
        *period, F.row_number().over(Window.orderBy(*period)).alias("_rank"), F.floor(F.count("*").over(everything) * fraction).alias("_train"))
    known = _checked(known, F.col("_train") > 0, "not enough periods for a split")
    return df.join(known, period).select(*df.columns, F.when(F.col("_rank") <= F.col("_train"), "train").otherwise("test").alias("part"))


def time_series_folds(df: DataFrame, bucket: str, order: list[str], k: int = 5) -> DataFrame:
    """Rows with (fold, role): k test blocks of n // (k + 1) rows at the end, everything before a block is its train part."""
    placed = positions(df, [], bucket, order)
    size = F.floor(F.col("scope_rows") / (k + 1))
    entries = []
    for fold in range(1, k + 1):
        start = F.col("scope_rows") - (k + 1 - fold) * size
        role = F.when(F.col("position") < start, "train").when(F.col("position") < start + size, "test")
        entries.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    out = placed.select("*", F.explode(F.array(*entries)).alias("_r")).select("*", "_r.*").drop("_r")
    return out.filter(F.col("role").isNotNull()).drop("scope_rows")


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides of a split."""
    return train.select(*keys).intersect(test.select(*keys))


def majority_baseline(train: DataFrame, label: str, labels: tuple) -> DataFrame:
    """One row: the most frequent label (ties in label order) and the class shares."""
    counts = [F.count_if(F.col(label) == x) for x in labels]
    top = F.greatest(*counts)
    pick = F.coalesce(*[F.when(c == top, x) for c, x in zip(counts, labels)])
    return train.agg(
        pick.alias("majority"), *[(c / F.count("*")).alias(f"share_{x}") for c, x in zip(counts, labels)]
    )


def assert_absent(df: DataFrame, column: str, forbidden: DataFrame) -> DataFrame:
    """Guard: fails while the rows are read if the value of any of them is among ``forbidden`` (one column)."""
    marked = df.join(forbidden.select(F.col(forbidden.columns[0]).alias(column)).distinct().withColumn("_seen", F.lit(True)), column, "left")
    message = F.concat(F.lit(f"{column} must stay unseen: "), F.col(column).cast("string"))
    return marked.filter(F.assert_true(F.col("_seen").isNull(), message).isNull()).select(*df.columns)
