"""League tables as they stood before a date, and pressure derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastward.functions.scalars import diff_or_null, max_or_null, points_for

# Fixed values of the pressure index.
MIN_GAMES = 8
PHASE_GAMES = 22
WINDOW_POINTS = 6
SEASON_GAMES = 38
GAP_RANKS = {"points_to_1st_before": 1, "points_to_4th_before": 4, "points_to_6th_before": 6}
SAFETY_RANK = 18

_TOTALS = ("games_played", "wins", "draws", "losses", "points", "goals_for", "goals_against")


def tables_by_date(rows: DataFrame, season: list[str]) -> DataFrame:
    """The table of every season on each of its match dates, matches of that date left out.

    All teams of the season appear, also before their first match. Matches are summed per
    (team, date) first; afterwards the size is dates x teams, whatever the number of matches.
    """
    daily = rows.groupBy(*season, "match_date", "team").agg(
        F.count("*").alias("games_played"),
        F.count_if(F.col("goals_for") > F.col("goals_against")).alias("wins"),
        F.count_if(F.col("goals_for") == F.col("goals_against")).alias("draws"),
        F.count_if(F.col("goals_for") < F.col("goals_against")).alias("losses"),
        F.sum(points_for("goals_for", "goals_against")).alias("points"),
        F.sum("goals_for").alias("goals_for"),
        F.sum("goals_against").alias("goals_against"),
    )
    dates = rows.select(*season, "match_date").distinct()
    teams = rows.select(*season, "team").distinct()
    grid = dates.join(teams, season).join(daily, [*season, "match_date", "team"], "left")
    past = Window.partitionBy(*season, "team").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    table = grid.select(
        *season, "match_date", "team", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_before") for c in _TOTALS]
    )
    table = table.withColumn("goal_diff_before", F.col("goals_for_before") - F.col("goals_against_before"))
    table = table.withColumn("ppg_before", F.try_divide("points_before", "games_played_before"))
    day = Window.partitionBy(*season, "match_date")
    ranking = day.orderBy(
        F.col("points_before").desc(), F.col("goal_diff_before").desc(), F.col("goals_for_before").desc(), "team"
    )
    table = table.withColumn("rank_before", F.row_number().over(ranking))

    def points_at(rank: int):
        return F.max(F.when(F.col("rank_before") == rank, F.col("points_before"))).over(day)

    gaps = {name: points_at(rank) - F.col("points_before") for name, rank in GAP_RANKS.items()}
    gaps["points_above_18th_before"] = F.col("points_before") - points_at(SAFETY_RANK)
    return table.withColumns(gaps)


def standings_before(rows: DataFrame, season: list[str]) -> DataFrame:
    """Standing of both sides before each match: two rows per match."""
    table = tables_by_date(rows, season)
    return rows.select("match_id", *season, "match_date", "team", "opponent", "venue").join(
        table, [*season, "match_date", "team"], "left"
    )


def pressure_columns() -> dict:
    """How much is at stake for a team; NULL before enough games are played."""
    games = F.col("games_played_before")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (games - MIN_GAMES) / PHASE_GAMES))

    def near(gap):
        closeness = F.when(gap.isNotNull(), F.greatest(F.lit(0.0), (WINDOW_POINTS - gap) / WINDOW_POINTS))
        return F.when(games >= MIN_GAMES, weight * closeness)

    parts = {
        "title_pressure": near(F.col("points_to_1st_before").cast("double")),
        "top4_pressure": near(F.abs(F.col("points_to_4th_before").cast("double"))),
        "top6_pressure": near(F.abs(F.col("points_to_6th_before").cast("double"))),
        "relegation_pressure": near(F.abs(F.col("points_above_18th_before").cast("double"))),
    }
    return parts | {"pressure_index": max_or_null(*parts.values())}


def pressure(standings: DataFrame) -> DataFrame:
    return standings.withColumns(pressure_columns())


def pressure_features(matches: DataFrame, rows: DataFrame, season: list[str]) -> DataFrame:
    """Match-level view: standing and pressure of both sides, differences, season progress.

    The tables are joined to the matches twice; nothing is regrouped by match.
    """
    table = pressure(tables_by_date(rows, season))
    wanted = [
        "games_played_before", "points_before", "ppg_before", "rank_before", "goal_diff_before",
        "title_pressure", "top4_pressure", "top6_pressure", "relegation_pressure", "pressure_index",
    ]
    out = matches.select("match_id", *season, "match_date", "home_team", "away_team")
    for side in ("home", "away"):
        part = table.select(
            *season, "match_date", F.col("team").alias(f"{side}_team"),
            *[F.col(c).alias(f"{side}_{c.removesuffix('_before')}_before") for c in wanted],
        )
        out = out.join(part, [*season, "match_date", f"{side}_team"], "left")
    return out.withColumns({
        "rank_diff_before": diff_or_null("home_rank_before", "away_rank_before"),
        "points_diff_before": diff_or_null("home_points_before", "away_points_before"),
        "ppg_diff_before": diff_or_null("home_ppg_before", "away_ppg_before"),
        "goal_diff_table_diff_before": diff_or_null("home_goal_diff_before", "away_goal_diff_before"),
        "match_pressure_index_before": max_or_null("home_pressure_index_before", "away_pressure_index_before"),
        "pressure_diff_before": diff_or_null("home_pressure_index_before", "away_pressure_index_before"),
        "season_progress_before": (F.col("home_games_played_before") + F.col("away_games_played_before")) / 2 / SEASON_GAMES,
    })
