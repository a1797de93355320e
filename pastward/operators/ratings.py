"""Sequential ratings.

A rating depends on all earlier ratings of both sides, so a league is a chain that no
plan can cut. The fold is kept as thin as it can be: six narrow columns are sorted by
Spark (which spills), stream through the task in Arrow batches, and the only state is
one number per team. Everything derived from the opening ratings is
computed by Spark afterwards, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastward.functions.scalars import outcome
from pastward.operators.history import latest_by
from pastward.operators.reshape import team_rows
from pastward.sources import versions
from pastward.sources.tables import materialize

# Fixed values of the rating.
INITIAL, NEWCOMER = 1500.0, 1400.0
HOME_ADVANTAGE, K, SCALE = 50.0, 20.0, 400.0


def expected_score(home, away, advantage: float = HOME_ADVANTAGE) -> Column:
    """Expected score of the home side."""
    return 1 / (1 + F.pow(F.lit(10.0), (away - (home + advantage)) / SCALE))


def season_starts(matches: DataFrame, league: str, season: str, time: str, state: DataFrame | None = None) -> DataFrame:
    """How each team enters each season: initial, carried or promoted_or_returning.

    With the state of earlier seasons, seasons are numbered on from it, and who played in its last season is carried.
    """
    in_league = Window.partitionBy(league).orderBy("_start", season)
    order = matches.groupBy(league, season).agg(F.min(time).alias("_start"))
    order = order.select(league, season, "_start", F.row_number().over(in_league).alias("season_index"))
    teams = matches.select(league, season, F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    if state is not None:
        order = _numbered_on(order, state, league, season)
    order = order.select(league, season, "season_index")
    teams = teams.join(order, [league, season])
    earlier = teams.select(league, "team", (F.col("season_index") + 1).alias("season_index"), F.lit(True).alias("_kept"))
    if state is not None:
        last = state.filter(F.col("season_index") == F.col("league_seasons"))
        earlier = earlier.unionByName(last.select(league, "team", (F.col("season_index") + 1).alias("season_index"), F.lit(True).alias("_kept")))
    return teams.join(earlier, [league, "team", "season_index"], "left").select(
        league, season, "team", "season_index",
        F.when(F.col("season_index") == 1, "initial")
        .when(F.col("_kept"), "carried")
        .otherwise("promoted_or_returning").alias("initialization"),
    )


def _numbered_on(order: DataFrame, state: DataFrame, league: str, season: str) -> DataFrame:
    """Season numbers after those of the state; a season that does not begin after the state's last one is an error."""
    known = state.groupBy(league).agg(F.max("league_seasons").alias("_before"), F.max("league_start").alias("_last"))
    joined = order.join(known, league, "left")
    late = F.col("_last").isNull() | (F.col("_start") > F.col("_last"))
    message = F.concat(F.lit("season "), F.col(season).cast("string"), F.lit(" does not begin after the seasons of the rating state"))
    guarded = joined.filter(F.assert_true(late, message).isNull())
    return guarded.withColumn("season_index", F.col("season_index") + F.coalesce("_before", F.lit(0))).drop("_before", "_last")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, ratings, seasons = object(), {}, {}
    names = ("league", "season", "home", "away", "score", "home_start", "away_start")
    for batch in batches:
        opening_home, opening_away = [], []
        for league, season, home, away, score, home_start, away_start in zip(*(batch[c].tolist() for c in names)):
            if league != current:
                current, ratings, seasons = league, {}, {}
            for team, start in ((home, home_start), (away, away_start)):
                if seasons.get(team) != season:
                    seasons[team] = season
                    if start == start:  # not missing: the season begins with a given rating
                        ratings[team] = start
            home_rating, away_rating = ratings[home], ratings[away]
            expected = 1 / (1 + 10 ** ((away_rating - (home_rating + HOME_ADVANTAGE)) / SCALE))
            ratings[home] = home_rating + K * (score - expected)
            ratings[away] = away_rating + K * ((1.0 - score) - (1 - expected))
            opening_home.append(home_rating)
            opening_away.append(away_rating)
        yield pd.DataFrame({
            "match_id": batch["match_id"], "home_elo_before": opening_home, "away_elo_before": opening_away,
        })


def elo(
    matches: DataFrame, league: str = "league", season: str = "season", time: str = "event_time", state: DataFrame | None = None,
) -> DataFrame:
    """Ratings of both sides before and after every match.

    Leagues run in parallel, each in the order (season start, time, match_id). With the ``state`` of earlier seasons (``season_end_state``)
    only the matches given are replayed; they must belong to later seasons.
    """
    starts = season_starts(matches, league, season, time, state)
    start = F.col("initialization")
    # The rating a season begins with; missing where the rating of the season before goes on inside the fold.
    given = F.when(start == "initial", INITIAL).when(start == "promoted_or_returning", NEWCOMER)
    if state is not None:
        held = state.select(league, "team", (F.col("season_index") + 1).alias("season_index"), F.col("rating").alias("_held"))
        starts = starts.join(held, [league, "team", "season_index"], "left")
        given = F.coalesce(given, F.when(start == "carried", F.col("_held")))
    starts = starts.withColumn("_given", given)

    def entry(side: str) -> DataFrame:
        return starts.select(
            league, season, F.col("team").alias(f"{side}_team"), F.col("initialization").alias(f"{side}_initialization"),
            F.col("_given").alias(f"_{side}_given"), *([F.col("season_index")] if side == "home" else []),
        )

    rows = matches.join(entry("home"), [league, season, "home_team"]).join(entry("away"), [league, season, "away_team"])
    score = F.when(F.col("home_goals") > F.col("away_goals"), 1.0).when(
        F.col("home_goals") == F.col("away_goals"), 0.5
    ).otherwise(0.0)
    chain = (
        rows.select(
            F.col(league).alias("league"), F.col("season_index").alias("season"), F.col(time).alias("time"), "match_id",
            F.col("home_team").alias("home"), F.col("away_team").alias("away"), score.alias("score"),
            F.col("_home_given").alias("home_start"), F.col("_away_given").alias("away_start"),
        )
        .repartition("league")
        .sortWithinPartitions("league", "season", "time", "match_id")
        .drop("time")
    )
    opening = chain.mapInPandas(_fold, "match_id long, home_elo_before double, away_elo_before double")
    home, away = F.col("home_elo_before"), F.col("away_elo_before")
    expected = expected_score(home, away)
    out = rows.join(opening, "match_id").select(
        "match_id", league, season, "match_date", time, "home_team", "away_team", "home_goals", "away_goals",
        outcome("home_goals", "away_goals").alias("result"),
        "home_elo_before", "away_elo_before",
        (home - away).alias("elo_diff_before"),
        ((home + HOME_ADVANTAGE) - away).alias("elo_diff_home_adjusted"),
        expected.alias("expected_home_score"),
        (1 - expected).alias("expected_away_score"),
        score.alias("actual_home_score"),
        (1 - score).alias("actual_away_score"),
        "home_initialization", "away_initialization",
    )
    return out.withColumns({
        "home_elo_delta": K * (F.col("actual_home_score") - F.col("expected_home_score")),
        "away_elo_delta": K * (F.col("actual_away_score") - F.col("expected_away_score")),
    }).withColumns({
        "home_elo_after": F.col("home_elo_before") + F.col("home_elo_delta"),
        "away_elo_after": F.col("away_elo_before") + F.col("away_elo_delta"),
    })


def current_ratings(ratings: DataFrame, league: list[str], time: str = "event_time") -> DataFrame:
    """Rating of every team after its last match."""
    sides = {
        "team": ("home_team", "away_team"),
        "rating": ("home_elo_after", "away_elo_after"),
    }
    rows = team_rows(ratings, [*league, "match_id", "match_date", time], sides).drop("venue")
    return latest_by(rows, [*league, "team"], [time, "match_id"])


STATE = ("team", "rating", "season_index", "match_id", "match_date")


def season_end_state(ratings: DataFrame, state: DataFrame | None = None, league: str = "league", season: str = "season", time: str = "event_time") -> DataFrame:
    """One row per (league, team): its rating after its last match, and how many seasons its league has seen.

    ``ratings`` are those of whole seasons by ``elo``, ``state`` the one they went on from; teams that did not play again keep
    their row of it. The state is as long as the list of teams, so going on from it costs what the new seasons cost.
    """
    seasons = ratings.groupBy(league, season).agg(F.min(time).alias("_start"))
    in_league = Window.partitionBy(league).orderBy("_start", season)
    seasons = seasons.withColumn("season_index", F.row_number().over(in_league))
    if state is not None:
        seasons = _numbered_on(seasons, state, league, season)
    sides = {"team": ("home_team", "away_team"), "rating": ("home_elo_after", "away_elo_after")}
    played = team_rows(ratings, [league, season, "match_id", "match_date", time], sides).drop("venue")
    # A team's last match is the last one of its last season; seasons follow each other by their beginning.
    last = played.join(seasons, [league, season]).groupBy(league, "team").agg(
        F.max_by(F.struct("rating", season, "season_index", "match_id", "match_date", time), F.struct("season_index", time, "match_id")).alias("_r"),
    ).select(league, "team", "_r.*")
    reached = seasons.groupBy(league).agg(F.max("season_index").alias("league_seasons"), F.max("_start").alias("league_start"))
    if state is not None:
        columns = [*last.columns]
        kept = state.select(*columns).join(last.select(league, "team"), [league, "team"], "left_anti")
        last = last.unionByName(kept.select(*columns))
        known = state.groupBy(league).agg(F.max("league_seasons").alias("league_seasons"), F.max("league_start").alias("league_start"))
        reached = reached.unionByName(known).groupBy(league).agg(F.max("league_seasons").alias("league_seasons"), F.max("league_start").alias("league_start"))
    return last.join(reached, league).select(league, *STATE[:2], season, *STATE[2:], time, "league_seasons", "league_start")


def save_state(state: DataFrame, path: str) -> int:
    """Commit the state as the next version of the table at ``path``; readers see the old one until it is complete."""
    last = versions.newest(state.sparkSession, path)
    number = 0 if last is None else last + 1
    versions.write(state, path, number)
    return number


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed state; None at the start."""
    number = versions.newest(spark, path)
    return None if number is None else spark.read.parquet(versions.folder(path, number))


def replay_seasons(matches: DataFrame, path: str, league: str = "league", season: str = "season", time: str = "event_time") -> DataFrame:
    """Rate whole new seasons from the stored state, store the new state, and return their ratings.

    Ratings are written once and read by both, so the fold runs once. Repeating a call whose state was stored is an error, as its seasons are in it.
    """
    state = load_state(matches.sparkSession, path)
    rated = materialize(elo(matches, league, season, time, state))
    save_state(season_end_state(rated, state, league, season, time), path)
    return rated
