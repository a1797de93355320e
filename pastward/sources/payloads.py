"""Nested JSON payloads to flat rows. Every parser takes rows with a JSON text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import blank_to_null, lenient_number, to_naive_utc

# Spellings of a finished match.
_DONE = ("1", "true", "yes")

def parse_match_json(df: DataFrame, column: str, season: str) -> DataFrame:
    """Finished matches from arrays of match objects; expected goals from either place, values strictly typed.

    ``validation_error`` names what is missing; NULL for a good row.
    """
    # Keys that differ in case only are read one by one from the text of the side.
    schema = (
        "array<struct<id:string,isResult:string,datetime:string,date:string,h:string,a:string,goals:string,xG:string>>"
    )
    rows = df.select(F.explode(F.from_json(column, schema)).alias("m")).select("m.*")
    rows = rows.filter(F.lower(F.trim("isResult")).isin(*_DONE))

    def side(key: str) -> dict[str, Column]:
        xg = F.coalesce(F.get_json_object(key, "$.xG"), F.get_json_object(key, "$.xg"), F.get_json_object("xG", f"$.{key}"))
        return {"team": blank_to_null(F.get_json_object(key, "$.title")), "xg": lenient_number(xg), "goals": lenient_number(F.get_json_object("goals", f"$.{key}"))}

    home, away = side("h"), side("a")
    day = F.to_date(F.coalesce("datetime", "date").try_cast("timestamp"))

    def whole(c: Column) -> Column:
        return F.when(c == F.floor(c), c.cast("int"))

    out = rows.select(
        blank_to_null("id").alias("feed_match_id"), F.lit(season).alias("season"), day.alias("match_date"),
        home["team"].alias("home_team"), away["team"].alias("away_team"), home["xg"].alias("home_xg"), away["xg"].alias("away_xg"),
        whole(home["goals"]).alias("home_goals"), whole(away["goals"]).alias("away_goals"),
    )
    error = F.concat_ws("; ", *[F.when(F.col(c).isNull(), f"missing {c}") for c in out.columns])
    return out.withColumn("validation_error", F.when(error != "", error))


def ratio_or_number(text: Column) -> Column:
    """``{"att": a, "def": d}`` as a / d (NULL for a missing or zero d), or a plain number."""
    pair = F.from_json(text, "att double, def double")
    return F.when(text.startswith("{"), F.try_divide(pair["att"], F.nullif(pair["def"], F.lit(0.0)))).otherwise(lenient_number(text))


def parse_team_history(df: DataFrame, column: str, season: int) -> DataFrame:
    """Team-match rows from a payload whose ``teams`` is an object by id or an array."""
    history = "array<struct<h_a:string,xG:string,xGA:string,npxG:string,npxGA:string,ppda:string,ppda_allowed:string,deep:string,deep_allowed:string,scored:string,missed:string,xpts:string,result:string,date:string,wins:string,draws:string,loses:string,pts:string,npxGD:string>>"
    team = f"struct<id:string,title:string,history:{history}>"
    teams = F.get_json_object(column, "$.teams")
    by_id = F.map_entries(F.from_json(teams, f"map<string,{team}>"))
    listed = F.transform(F.from_json(teams, f"array<{team}>"), lambda t: F.struct(t["id"].alias("key"), t.alias("value")))
    rows = df.select(F.explode(F.when(F.trim(teams).startswith("["), listed).otherwise(by_id)).alias("t")).select(
        F.coalesce("t.value.id", "t.key").alias("team_id"), F.col("t.value.title").alias("team_name"), F.explode("t.value.history").alias("r")
    )
    number = {"xg": "xG", "xga": "xGA", "npxg": "npxG", "npxga": "npxGA", "npxgd": "npxGD", "deep": "deep", "deep_allowed": "deep_allowed", "xpts": "xpts"}
    whole = {"scored": "scored", "missed": "missed", "pts": "pts", "wins": "wins", "draws": "draws", "loses": "loses"}
    return rows.select(
        F.lit(season).alias("season"), lenient_number("team_id", "int").alias("team_id"), blank_to_null("team_name").alias("team_name"),
        F.to_date(F.col("r.date").try_cast("timestamp")).alias("match_date"), F.col("r.h_a").alias("venue"), F.col("r.result").alias("result"),
        *[lenient_number(f"r.{src}").alias(name) for name, src in number.items()],
        ratio_or_number(F.col("r.ppda")).alias("ppda"), ratio_or_number(F.col("r.ppda_allowed")).alias("ppda_allowed"),
        *[lenient_number(f"r.{src}", "int").alias(name) for name, src in whole.items()],
    )


_PLAYER = {
    "player_id": ("id", "int"), "team_id": ("team", "int"), "position_id": ("element_type", "int"), "now_cost": ("now_cost", "int"),
    "total_points": ("total_points", "int"), "selected_by_percent": ("selected_by_percent", "double"), "form": ("form", "double"),
    "chance_of_playing_next_round": ("chance_of_playing_next_round", "int"), "chance_of_playing_this_round": ("chance_of_playing_this_round", "int"),
}


def _event(events: Column) -> Column:
    """Next, else current, else previous, else first event."""

    def flagged_with(flag: str) -> Column:
        return F.filter(events, lambda e: F.coalesce(e[flag], F.lit(False)))

    flagged = [flagged_with(f) for f in ("is_next", "is_current", "is_previous")]
    return F.coalesce(*[F.get(x, F.lit(0)) for x in flagged], F.get(events, F.lit(0)))


_TEAMS = "array<struct<id:int,name:string,short_name:string>>"


def _team_names(teams: Column) -> Column:
    return F.map_from_entries(F.transform(teams, lambda t: F.struct(t["id"], F.coalesce(t["name"], t["short_name"], t["id"].cast("string")))))


def parse_player_snapshot(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """Player rows of a bootstrap payload, with team names and the relevant event.

    Teams and events are short lists inside the payload, looked up in the row: no join.
    """
    events = F.from_json(F.get_json_object(column, "$.events"), "array<struct<id:int,deadline_time:string,is_next:boolean,is_current:boolean,is_previous:boolean>>")
    rows = df.select(
        *keep, _event(events).alias("event"), _team_names(F.from_json(F.get_json_object(column, "$.teams"), _TEAMS)).alias("names"),
        F.explode(F.from_json(F.get_json_object(column, "$.elements"), "array<string>")).alias("raw_player_json"),
    )

    def text(key: str) -> Column:
        return F.get_json_object("raw_player_json", f"$.{key}")

    full = F.trim(F.concat_ws(" ", blank_to_null(text("first_name")), blank_to_null(text("second_name"))))
    out = rows.select(
        *keep, F.col("event.id").alias("event_id"), to_naive_utc("event.deadline_time").alias("deadline_time"), "names", "raw_player_json",
        F.coalesce(blank_to_null(full), text("web_name"), text("id")).alias("player_name"), text("web_name").alias("web_name"),
        *[lenient_number(text(src), kind).alias(name) for name, (src, kind) in _PLAYER.items()],
        text("status").alias("status"), blank_to_null(text("news")).alias("news"), to_naive_utc(text("news_added")).alias("news_added"),
    )
    return out.withColumn("team_name", F.try_element_at("names", F.col("team_id"))).drop("names")


def parse_fixture_snapshot(df: DataFrame, fixtures: str, bootstrap: str, keep: list[str] = ()) -> DataFrame:
    """Fixture rows of a fixtures payload; team names come from the bootstrap payload in the same row."""
    rows = df.select(
        *keep, _team_names(F.from_json(F.get_json_object(bootstrap, "$.teams"), _TEAMS)).alias("names"),
        F.explode(F.from_json(fixtures, "array<string>")).alias("raw_fixture_json"),
    )

    def text(key: str) -> Column:
        return F.get_json_object("raw_fixture_json", f"$.{key}")

    ints = {"event_id": "event", "fixture_id": "id", "team_h_id": "team_h", "team_a_id": "team_a", "team_h_score": "team_h_score", "team_a_score": "team_a_score"}
    flags = ("finished", "started", "finished_provisional")
    out = rows.select(
        *keep, "names", "raw_fixture_json", to_naive_utc(text("kickoff_time")).alias("kickoff_time"),
        *[lenient_number(text(src), "int").alias(name) for name, src in ints.items()],
        *[text(f).try_cast("boolean").alias(f) for f in flags],
    )
    return out.withColumns({
        "team_h_name": F.try_element_at("names", F.col("team_h_id")), "team_a_name": F.try_element_at("names", F.col("team_a_id")),
    }).drop("names")


# Statistics of a live period and their default where they are absent.
LIVE_INTEGERS = ["minutes", "total_points", "goals_scored", "assists", "clean_sheets", "saves", "bonus", "starts"]
LIVE_NUMBERS = ["expected_goals", "expected_assists"]


def parse_live_period(df: DataFrame, column: str, identity: DataFrame, season: str, period: int) -> DataFrame:
    """Player rows of a live payload with the identity known so far; absent whole-number statistics count 0."""
    rows = df.select(F.explode(F.from_json(F.get_json_object(column, "$.elements"), "array<string>")).alias("raw_stats_json"))
    player = lenient_number(F.get_json_object("raw_stats_json", "$.id"), "int")
    stats = {c: F.coalesce(lenient_number(F.get_json_object("raw_stats_json", f"$.stats.{c}"), "int"), F.lit(0)) for c in LIVE_INTEGERS}
    stats |= {c: lenient_number(F.get_json_object("raw_stats_json", f"$.stats.{c}")) for c in LIVE_NUMBERS}
    out = rows.select(
        F.lit(season).alias("target_season"), F.lit(period).alias("gameweek"), player.alias("player_id"), "raw_stats_json",
        *[v.alias(k) for k, v in stats.items()],
    )
    known = identity.select("player_id", "code", "player_name", "team_id", "position_id")
    return out.join(known, "player_id", "left").withColumns({
        "player_name": F.coalesce("player_name", F.col("player_id").cast("string")),
        "identity_status": F.when(F.col("code").isNotNull(), "matched").otherwise("unmatched"),
    })


_HISTORY_INTS = [
    "fixture", "opponent_team", "total_points", "team_h_score", "team_a_score", "minutes", "goals_scored", "assists", "clean_sheets",
    "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus", "bps", "starts",
    "value", "selected", "transfers_balance", "transfers_in", "transfers_out",
]
_HISTORY_NUMBERS = [
    "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
]


def parse_player_history(df: DataFrame, player: str, column: str) -> DataFrame:
    """Season rows of a player payload; fields that are absent are NULL."""
    rows = df.select(player, F.explode(F.from_json(F.get_json_object(column, "$.history"), "array<map<string,string>>")).alias("h"))

    def at(key: str) -> Column:
        return F.try_element_at("h", F.lit(key))

    return rows.select(
        player, lenient_number(at("round"), "int").alias("gameweek"), to_naive_utc(at("kickoff_time")).alias("kickoff_time"),
        at("was_home").try_cast("boolean").alias("was_home"), *[lenient_number(at(c), "int").alias(c) for c in _HISTORY_INTS],
        *[lenient_number(at(c)).alias(c) for c in _HISTORY_NUMBERS],
    )


_CLEAN_TEXT = ["first_name", "second_name", "status", "news"]
_CLEAN_INTS = ["id", "team", "element_type", "total_points", "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "bonus", "starts"]
_CLEAN_NUMBERS = [
    "now_cost", "form", "selected_by_percent", "chance_of_playing_this_round", "chance_of_playing_next_round", "influence", "creativity",
    "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
]


def clean_players(df: DataFrame) -> DataFrame:
    """Player master in a fixed layout: absent columns NULL, price in whole units, availability from the status."""

    def col(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    columns = {c: col(c).cast("string") for c in _CLEAN_TEXT}
    columns |= {c: lenient_number(col(c), "int") for c in _CLEAN_INTS}
    columns |= {c: lenient_number(col(c)) for c in _CLEAN_NUMBERS}
    columns["position"] = columns.pop("element_type")
    columns["now_cost"] = columns["now_cost"] / 10
    columns["is_available"] = F.coalesce(col("status") == "a", F.lit(False))
    return df.select(*[v.alias(k) for k, v in columns.items()])
