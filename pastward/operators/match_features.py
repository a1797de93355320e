"""Form features of matches, seen before the match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import outcome, points_for
from pastward.operators.history import carried_by_kind, history_count, history_mean, prior_strict, tails

_VALUES = ["points", "goal_diff", "goals_for", "goals_against", "clean_sheet", "xg_for", "xg_against"]


def _with_values(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "points": points_for("goals_for", "goals_against"),
        "goal_diff": F.col("goals_for") - F.col("goals_against"),
        "clean_sheet": (F.col("goals_against") == 0).cast("int"),
    })


def overall_features() -> dict:
    """Form over all matches of a team, last 5 and last 10."""
    return {
        "overall_matches_last5": history_count(5),
        "overall_matches_last10": history_count(10),
        "points_overall_last5": history_mean("points", 5),
        "points_overall_last10": history_mean("points", 10),
        "goal_diff_overall_last5": history_mean("goal_diff", 5),
        "xg_overall_last5": history_mean("xg_for", 5),
        "xga_overall_last5": history_mean("xg_against", 5),
    }


def venue_features(side: str, history: str = "kind_history") -> dict:
    """Form over the matches of a team at one venue, last 5."""
    return {
        f"{side}_matches_last5": history_count(5, history),
        f"goals_scored_{side}_last5": history_mean("goals_for", 5, history),
        f"goals_conceded_{side}_last5": history_mean("goals_against", 5, history),
        f"clean_sheet_rate_{side}_last5": history_mean("clean_sheet", 5, history),
        f"xg_{side}_last5": history_mean("xg_for", 5, history),
        f"xga_{side}_last5": history_mean("xg_against", 5, history),
    }


def _prefixed(df: DataFrame, keys: dict[str, str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(keys.get(c, f"{prefix}_{c}")) for c in df.columns])


def base_match_features(matches: DataFrame, rows: DataFrame, league: list[str], time: str = "event_time") -> DataFrame:
    """One row per match: targets, six history counts and twenty form means.

    Histories are built once per (team, time, venue), far fewer rows than matches at scale, with the
    last 10 overall and the last 5 at the venue from one pass, and joined to the matches by equality.
    """
    team = [*league, "team"]
    past = carried_by_kind(_with_values(rows), team, time, "venue", ["match_id"], _VALUES, 10, 5)
    result = outcome("home_goals", "away_goals")
    keep = dict.fromkeys(["match_id", *league, "season", "match_date", time, "home_team", "away_team"])
    out = matches.select(
        *keep,
        "home_goals",
        "away_goals",
        result.alias("result"),
        (result == "H").cast("int").alias("home_win"),
        (result == "D").cast("int").alias("is_draw"),
        (result == "A").cast("int").alias("away_win"),
    )
    for side, venue in (("home", "H"), ("away", "A")):
        keys = {"team": f"{side}_team", time: time} | {c: c for c in league}
        form = past.filter(F.col("venue") == venue).select(
            *team, time, *[v.alias(k) for k, v in (overall_features() | venue_features(side)).items()]
        )
        out = out.join(_prefixed(form, keys, side), [*league, f"{side}_team", time], "left")
    return out


def latest_team_state(rows: DataFrame, league: list[str], time: str = "event_time") -> DataFrame:
    """Form of every team up to now: last 5 at home, last 5 away, last 5 and 10 overall."""
    team, sides = [*league, "team"], {"home": "H", "away": "A"}
    latest = tails(_with_values(rows), [*team, "venue"], [time, "match_id"], _VALUES, 10)
    frames = {f"_{side}": F.slice(F.flatten(F.collect_list(F.when(F.col("venue") == venue, F.col("tail")))), 1, 5) for side, venue in sides.items()}
    frames["history"] = F.slice(F.sort_array(F.flatten(F.collect_list("tail")), asc=False), 1, 10)
    state = latest.groupBy(*team).agg(*[v.alias(k) for k, v in frames.items()])
    return state.select(
        *team,
        *[v.alias(k) for k, v in overall_features().items()],
        *[v.alias(f"{side}_{k}") for side in sides for k, v in venue_features(side, f"_{side}").items()],
    )


def mature_style_features(matches: DataFrame, rows: DataFrame, league: list[str], time: str = "event_time") -> DataFrame:
    """Attack and defence means that exist only with a full window behind them."""
    team = [*league, "team"]
    per_time = prior_strict(rows, team, time, ["match_id"], ["xg_for", "xg_against"], 10)
    parts = {
        f"{part}_last{n}": history_mean(col, n, min_rows=n)
        for n in (5, 10)
        for part, col in (("attack_xg", "xg_for"), ("defense_xga", "xg_against"))
    }
    style = per_time.select(*team, time, *[v.alias(k) for k, v in parts.items()])
    out = matches.select("match_id", *league, time, "home_team", "away_team")
    for side in ("home", "away"):
        keys = {"team": f"{side}_team", time: time} | {c: c for c in league}
        out = out.join(_prefixed(style, keys, side), [*league, f"{side}_team", time], "left")
    for n in (5, 10):
        out = out.withColumns({
            f"home_attack_minus_away_defense_last{n}": F.col(f"home_attack_xg_last{n}") - F.col(f"away_defense_xga_last{n}"),
            f"away_attack_minus_home_defense_last{n}": F.col(f"away_attack_xg_last{n}") - F.col(f"home_defense_xga_last{n}"),
        })
        out = out.withColumn(
            f"style_xg_pressure_diff_last{n}",
            F.col(f"home_attack_minus_away_defense_last{n}") - F.col(f"away_attack_minus_home_defense_last{n}"),
        )
    return out


def upcoming_features(
    fixtures: DataFrame,
    state: DataFrame,
    ratings: DataFrame,
    league: list[str],
    home_advantage: float = 50.0,
    newcomer_rating: float = 1400.0,
) -> DataFrame:
    """Feature row per upcoming fixture from the current state of both sides.

    A team without a rating starts at the newcomer rating; a team without history gets
    a state of zeros. A team with some history keeps its NULLs.
    """
    state_cols = [c for c in state.columns if c not in {*league, "team"}]
    known = state.withColumn("_known", F.lit(True))
    out = fixtures
    for side in ("home", "away"):
        drop = "away" if side == "home" else "home"
        wanted = [c for c in state_cols if not c.startswith(f"{drop}_")]
        names = {c: c if c.startswith(f"{side}_") else f"{side}_{c}" for c in wanted}
        part = known.select(
            *league, F.col("team").alias(f"{side}_team"), *[F.col(c).alias(names[c]) for c in wanted],
            F.col("_known").alias(f"_{side}_known"),
        )
        rating = ratings.select(*league, F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"{side}_elo_before"))
        on = [*league, f"{side}_team"]
        out = out.join(part, on, "left").join(rating, on, "left")
        out = out.withColumns(
            {names[c]: F.when(F.col(f"_{side}_known"), F.col(names[c])).otherwise(F.lit(0)) for c in wanted}
        ).drop(f"_{side}_known")
        out = out.fillna(newcomer_rating, subset=[f"{side}_elo_before"])
    gap = F.col("home_elo_before") - F.col("away_elo_before")
    expected = 1 / (1 + F.pow(F.lit(10.0), -(gap + home_advantage) / 400))
    return out.withColumns({
        "elo_diff_before": gap,
        "elo_diff_home_adjusted": gap + home_advantage,
        "expected_home_score": expected,
        "expected_away_score": 1 - expected,
    })
