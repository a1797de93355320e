"""History of unordered pairs, told from the point of view of the current first side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastward.functions.scalars import outcome, points_for

_TOTALS = ("n", "wins_lo", "wins_hi", "goals_lo", "goals_hi", "points_lo", "points_hi")


def pair_history(matches: DataFrame, league: list[str], time: str = "event_time") -> DataFrame:
    """Sixteen columns on earlier meetings of the two sides, per match.

    Meetings are added up per (pair, time) before any window, so the window holds one
    row per distinct time of a pair and rows of equal time never see one another.
    """
    home_is_hi = F.col("home_team") > F.col("away_team")
    rows = matches.select(
        *league, time, "match_id", "match_date",
        F.least("home_team", "away_team").alias("lo"),
        F.greatest("home_team", "away_team").alias("hi"),
        F.when(home_is_hi, F.col("away_goals")).otherwise(F.col("home_goals")).alias("g_lo"),
        F.when(home_is_hi, F.col("home_goals")).otherwise(F.col("away_goals")).alias("g_hi"),
    )
    pair = [*league, "lo", "hi"]
    per_time = rows.groupBy(*pair, time).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("g_lo") > F.col("g_hi")).alias("wins_lo"),
        F.count_if(F.col("g_hi") > F.col("g_lo")).alias("wins_hi"),
        F.sum("g_lo").alias("goals_lo"),
        F.sum("g_hi").alias("goals_hi"),
        F.sum(points_for("g_lo", "g_hi")).alias("points_lo"),
        F.sum(points_for("g_hi", "g_lo")).alias("points_hi"),
        F.max(F.struct("match_id", "match_date", "g_lo", "g_hi")).alias("last"),
    )
    ordered = Window.partitionBy(*pair).orderBy(time)
    past = ordered.rowsBetween(Window.unboundedPreceding, -1)
    history = per_time.select(
        *pair, time, *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in _TOTALS],
        F.lag("last").over(ordered).alias("last"),
    )
    current = matches.select(
        "match_id", *league, time, "match_date", "home_team", "away_team", home_is_hi.alias("flip"),
        F.least("home_team", "away_team").alias("lo"), F.greatest("home_team", "away_team").alias("hi"),
    ).withColumnRenamed("match_date", "today")
    joined = current.join(history, [*pair, time], "left")

    def home(c: str):
        return F.when(F.col("flip"), F.col(f"{c}_hi")).otherwise(F.col(f"{c}_lo"))

    def away(c: str):
        return F.when(F.col("flip"), F.col(f"{c}_lo")).otherwise(F.col(f"{c}_hi"))

    n = F.col("n")
    draws = n - F.col("wins_lo") - F.col("wins_hi")
    last_home = F.when(F.col("flip"), F.col("last.g_hi")).otherwise(F.col("last.g_lo"))
    last_away = F.when(F.col("flip"), F.col("last.g_lo")).otherwise(F.col("last.g_hi"))
    return joined.select(
        "match_id",
        n.alias("h2h_matches_prior"),
        home("wins").alias("h2h_home_wins_prior"),
        draws.alias("h2h_draws_prior"),
        away("wins").alias("h2h_away_wins_prior"),
        F.try_divide(home("goals"), n).alias("h2h_home_goals_avg_prior"),
        F.try_divide(away("goals"), n).alias("h2h_away_goals_avg_prior"),
        F.try_divide(home("points"), n).alias("h2h_home_points_avg_prior"),
        F.try_divide(away("points"), n).alias("h2h_away_points_avg_prior"),
        F.try_divide(home("goals") - away("goals"), n).alias("h2h_goal_diff_avg_prior"),
        F.try_divide(home("wins"), n).alias("h2h_home_win_rate_prior"),
        F.try_divide(draws, n).alias("h2h_draw_rate_prior"),
        F.try_divide(away("wins"), n).alias("h2h_away_win_rate_prior"),
        F.datediff("today", "last.match_date").alias("h2h_last_meeting_days"),
        last_home.alias("h2h_last_meeting_home_goals"),
        last_away.alias("h2h_last_meeting_away_goals"),
        outcome(last_home, last_away).alias("h2h_last_meeting_result"),
    )


def apply_min_evidence(df: DataFrame, count: str, minimum: int, cols: list[str]) -> DataFrame:
    """Blank a block of columns where there is too little history behind it."""
    return df.withColumns({c: F.when(F.col(count) >= minimum, F.col(c)) for c in cols})
