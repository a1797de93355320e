"""Squads: which players can matter, and which squads are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the squad rules. Costs are in tenths.
SQUAD_SIZE, PER_TEAM, BUDGET = 15, 3, 1000
QUOTAS = {1: 2, 2: 5, 3: 5, 4: 3}
STARTERS = 11
FORMATION = {1: (1, 1), 2: (3, 5), 3: (2, 5), 4: (1, 3)}


def undominated(players: DataFrame, group: list[str], cost: str, points: str, row_id: str, keep: int = PER_TEAM) -> DataFrame:
    """Players of a (team, position) that can be in a best squad.

    A player with ``keep`` others of the group that cost no more and score no less is never
    needed, as at most that many of a team are allowed. Players are first cut to the best
    ``keep`` per price, before any shuffle. Then they are ordered by price, best first, and the ``keep``-th best score before a
    player decides. The best scores so far are running maxima: whatever a new score beats, or is beaten by, moves on to the
    next place. Nothing is collected.
    """
    level = Window.partitionBy(*group, cost).orderBy(F.col(points).desc(), row_id)
    rows = players.withColumn("_at_price", F.row_number().over(level)).filter(F.col("_at_price") <= keep)
    before = Window.partitionBy(*group).orderBy(cost, F.col(points).desc(), row_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_moving", F.col(points))
    for _ in range(keep):
        rows = rows.withColumn("_best", F.max("_moving").over(before))
        rows = rows.withColumn("_moving", F.when(F.col("_best").isNotNull(), F.least("_moving", "_best")))
    return rows.filter(F.col("_best").isNull() | (F.col("_best") < F.col(points))).select(*players.columns)


def squad_check(squads: DataFrame, squad: str, budget: int = BUDGET) -> DataFrame:
    """Size, quotas, players per team, cost and points of every squad, and whether it is allowed."""
    per_team = squads.groupBy(squad, "team_id").agg(
        F.count("*").alias("_n"), F.sum("now_cost").alias("_cost"), F.sum("expected_points").alias("_points"),
        *[F.count_if(F.col("position") == p).alias(f"_p{p}") for p in QUOTAS],
    )
    out = per_team.groupBy(squad).agg(
        F.sum("_n").alias("players"), *[F.sum(f"_p{p}").alias(f"position_{p}") for p in QUOTAS],
        F.max("_n").alias("most_per_team"), F.sum("_cost").alias("cost"), F.sum("_points").alias("points"),
    )
    allowed = (F.col("players") == SQUAD_SIZE) & (F.col("most_per_team") <= PER_TEAM) & (F.col("cost") <= budget)
    for p, n in QUOTAS.items():
        allowed = allowed & (F.col(f"position_{p}") == n)
    return out.withColumn("allowed", allowed)


def formation_check(starters: DataFrame, squad: str) -> DataFrame:
    """Starting elevens: size, players per position, validity of the formation."""
    out = starters.groupBy(squad).agg(
        F.count("*").alias("starters"), *[F.count_if(F.col("position") == p).alias(f"position_{p}") for p in FORMATION]
    )
    valid = F.col("starters") == STARTERS
    for p, (low, high) in FORMATION.items():
        valid = valid & F.col(f"position_{p}").between(low, high)
    return out.withColumn("valid", valid)


def captains(starters: DataFrame, squad: str, score: str, row_id: str) -> DataFrame:
    """Captain and vice-captain: the two best starters."""
    w = Window.partitionBy(squad).orderBy(F.col(score).desc(), row_id)
    top = starters.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= 2)
    return top.select(squad, row_id, score, F.when(F.col("_rank") == 1, "captain").otherwise("vice_captain").alias("role"))


def candidate_pool(players: DataFrame, available: Column, playing: Column) -> DataFrame:
    """Strict pool (available and playing), or all available players where the strict pool misses a quota.

    Whether the strict pool suffices is one row of counts.
    """
    enough = F.lit(True)
    for p, n in QUOTAS.items():
        enough = enough & (F.count_if(available & playing & (F.col("position") == p)) >= n)
    strict = players.agg(enough.alias("_strict"))
    return players.filter(available).join(F.broadcast(strict)).filter(playing | ~F.col("_strict")).withColumn(
        "pool", F.when(F.col("_strict"), "strict").otherwise("available")
    ).drop("_strict")


def availability(chance, status) -> Column:
    """Share of the chance to play; 0 for players who are out."""
    c = F.coalesce(F.col(chance).try_cast("double"), F.lit(100.0)) / 100
    return F.when(F.lower(F.trim(status)).isin("i", "n", "s", "u"), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def start_probability(df: DataFrame) -> Column:
    """Chance to start from news, recent minutes and recent starts."""
    status = F.lower(F.trim("status"))
    out = ~F.coalesce(F.col("is_available"), F.lit(False)) | F.coalesce(status.isin("i", "s"), F.lit(False))
    chance = F.coalesce(F.col("chance_next"), F.col("chance_this")).cast("double") / 100
    base = F.coalesce(chance, F.when(status.isNull() | (status == "a"), 0.95).otherwise(0.5))
    minutes, starts, season = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("minutes_last5", "starts_last5", "season_minutes"))
    base = base + F.when((starts >= 0.8) | (minutes >= 70), 0.05).otherwise(0.0)
    base = base - F.when((minutes < 30) & (season > 0), 0.10).otherwise(0.0)
    base = F.when(season == 0, F.least(base, F.lit(0.2))).otherwise(base)
    return F.when(out, 0.0).otherwise(F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0)))


def sanity_capped(df: DataFrame, points: str) -> DataFrame:
    """Caps in order: few minutes at most 0.5, little history at most 1.0, unavailable 0."""
    season, minutes, starts, matches = (
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("season_minutes", "minutes_last5", "starts_last5", "matches_last5")
    )
    playing = (season >= 90) | (minutes >= 20) | (starts >= 0.4)
    value = F.coalesce(F.col(points).cast("double"), F.lit(0.0))
    value = F.when(~playing, F.least(value, F.lit(0.5))).otherwise(value)
    value = F.when(matches < 3, F.least(value, F.lit(1.0))).otherwise(value)
    value = F.when(F.coalesce(F.col("is_available"), F.lit(False)), value).otherwise(0.0)
    return df.withColumns({"is_playing_candidate": playing, points: value})


def rule_points() -> Column:
    """Points by position when no model is at hand."""
    form, sheets, share, goals, assists = (
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("form", "clean_sheets", "minutes_ratio", "goals_scored", "assists")
    )
    defence = sheets * 6 * share
    extra = (
        F.when(F.col("position") == 1, defence)
        .when(F.col("position") == 2, goals * 6 + assists * 3 + defence)
        .when(F.col("position") == 3, goals * 5 + assists * 3)
        .when(F.col("position") == 4, goals * 4 + assists * 3)
        .otherwise(0.0)
    )
    return F.when(F.coalesce(F.col("is_available"), F.lit(False)), form + extra / 38.0).otherwise(0.0)


def captain_score(points: str, form: str) -> Column:
    return F.coalesce(F.col(points), F.lit(0.0)) + 0.4 * F.coalesce(F.col(form), F.lit(0.0))
