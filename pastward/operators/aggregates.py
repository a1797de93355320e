"""Grouped aggregates with fixed tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.reshape import struct_rows


def side_season_summary(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Season totals per team, home and away kept as two rows."""
    from pastward.functions.scalars import half_up
    from pastward.operators.reshape import team_rows

    rows = team_rows(matches, keys, {
        "team": ("home_team", "away_team"), "goals_for": ("home_goals", "away_goals"), "goals_against": ("away_goals", "home_goals"),
    })
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return rows.groupBy(*keys, "team", "venue").agg(
        F.count("*").alias("total_matches"), F.sum(gf).alias("goals_scored"), F.sum(ga).alias("goals_conceded"),
        F.count_if(gf > ga).alias("wins"), F.count_if(gf == ga).alias("draws"), F.count_if(ga == 0).alias("clean_sheets"),
        half_up(F.avg(gf), 2).alias("avg_goals_scored"), half_up(F.avg(ga), 2).alias("avg_goals_conceded"),
    )


def ordered_pair_summary(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per ordered pair of teams."""
    from pastward.functions.scalars import half_up

    h, a = F.col("home_goals"), F.col("away_goals")
    return matches.groupBy(*keys, "home_team", "away_team").agg(
        F.count("*").alias("meetings"), F.count_if(h > a).alias("home_wins"), F.count_if(h < a).alias("away_wins"),
        F.count_if(h == a).alias("draws"), half_up(F.avg((h > a).cast("int")), 2).alias("home_win_rate"),
        half_up(F.avg(h), 2).alias("avg_home_goals"), half_up(F.avg(a), 2).alias("avg_away_goals"),
    )


def modes(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Most frequent known value per group and column, the smallest one on ties; NULL when none is known.

    Counted per (group, column, value) first, so no task holds the values of a whole group.
    """
    stacked = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x"))
    counts = stacked.select(*keys, "x.*").groupBy(*keys, "c", "v").agg(F.count("v").alias("n"))
    return counts.groupBy(*keys).agg(*[
        F.min_by("v", F.when((F.col("c") == c) & F.col("v").isNotNull(), F.struct(-F.col("n"), F.col("v")))).alias(c) for c in cols
    ])


def distinct_lists(df: DataFrame, keys: list[str], value: str, limit: int, name: str = "examples") -> DataFrame:
    """Groups with several distinct values: counts and the ordered list of values, the largest groups first.

    Which groups are reported is settled on counts alone; values are strung together only for those.
    """
    pairs = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sizes = pairs.groupBy(*keys).agg(F.count(value).alias("distinct_count"), F.sum("_n").alias("rows"))
    top = sizes.filter(F.col("distinct_count") > 1).orderBy(F.col("distinct_count").desc(), F.col("rows").desc(), *keys).limit(limit)
    joined = pairs.join(F.broadcast(top), keys)  # at most ``limit`` rows
    return joined.groupBy(*keys, "distinct_count", "rows").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list(value))).alias(name)
    )


def correlations(df: DataFrame, left: list[str], right: list[str], flag_at: float = 0.95) -> DataFrame:
    """Pearson correlation of all column pairs in one pass; rows with a NULL in a pair and constant columns are left out."""
    cells = []
    for a in left:
        for b in right:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
            varies = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))
            cells.append(F.struct(
                F.lit(a).alias("feature"), F.lit(b).alias("base_feature"),
                F.when(varies, F.try_divide(F.covar_pop(x, y), spread)).alias("corr"), F.count_if(both).alias("paired_rows"),
            ).alias(f"{a}__{b}"))
    rows = struct_rows(df.agg(*cells), [F.col(f"{a}__{b}") for a in left for b in right])
    rows = rows.filter(F.col("corr").isNotNull())
    return rows.withColumns({"abs_corr": F.abs("corr"), "redundant": F.abs("corr") >= flag_at})


def cross_tab(df: DataFrame, row: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts per row key and column value, absent values as 0."""
    return df.groupBy(*row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def latest_run(df: DataFrame, run: str, aggregates: list[Column]) -> DataFrame:
    """Metadata of the newest run."""
    return df.groupBy(run).agg(*aggregates).orderBy(F.col(run).desc()).limit(1)
