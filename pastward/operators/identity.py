"""Matching players across seasons and flagging what a person should look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import is_present, normalize_name

KEY = ["season", "player_source_id"]
NAMES = ["player_name", "team_name", "position"]

# How a row was matched, and the review reasons in the order in which they are listed.
EXACT, UNMATCHED = "element_id_exact", "unmatched"
REVIEW_REASONS = (
    "no_players_raw_csv_for_season",
    "unmatched_player_source_id",
    "duplicate_season_player_source_id",
    "duplicate_season_fpl_code",
    "fpl_code_multiple_names",
    "fpl_code_multiple_players_one_season",
    "conflicting_player_name",
    "conflicting_position",
    "conflicting_team_mappings",
    "conflicting_position_mappings",
    "same_season_team_overlap",
)


def count_cube(history: DataFrame) -> DataFrame:
    """Rows, periods and totals per (season, source id, name, team, position), the only pass over the history."""
    return history.filter(is_present("player_source_id")).groupBy(*KEY, *NAMES).agg(
        F.count("*").alias("n"), F.min("gameweek").alias("first"), F.max("gameweek").alias("last"),
        F.sum("minutes").alias("minutes"), F.sum("total_points").alias("points"),
    )


def history_summary(history: DataFrame) -> DataFrame:
    """One row per (season, source id): usual name, team and position, spread and totals.

    All of it is read off the cells of ``count_cube``. These are spread by key once; the sums per value, per trimmed
    value and per key that follow need no further shuffle. The most frequent known value is the usual one, the smallest on ties.
    """
    cells = count_cube(history).repartition(*KEY)
    measures = ("first", "last", "minutes", "points")
    values = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"), *[(F.col(m) if c == NAMES[0] else F.lit(None)).alias(m) for m in measures])
        for c in NAMES
    ]))
    stacked = cells.select(*KEY, "n", values.alias("x")).select(*KEY, "n", "x.*")
    totals = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("minutes").alias("minutes"), F.sum("points").alias("points")]
    per_value = stacked.groupBy(*KEY, "c", "v").agg(*totals)
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("v").alias("v")))).alias("best")
    per_trimmed = per_value.groupBy(*KEY, "c", F.trim("v").alias("t")).agg(best, *totals)

    def spread(column: str):
        return F.count_if((F.col("c") == column) & F.col("t").isNotNull() & (F.col("t") != ""))

    return per_trimmed.groupBy(*KEY).agg(
        spread("team_name").alias("distinct_team_names"), spread("position").alias("distinct_positions"),
        F.min("first").alias("first_gameweek"), F.max("last").alias("last_gameweek"),
        F.sum(F.when(F.col("c") == NAMES[0], F.col("n"))).alias("row_count"),
        F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes_total"), F.coalesce(F.sum("points"), F.lit(0)).alias("points_total"),
        *[F.min(F.when(F.col("c") == c, F.col("best")))["v"].alias(c) for c in NAMES],
    )


def identity_join(summary: DataFrame, master: DataFrame) -> DataFrame:
    """Exact match of (season, source id) with the master list of the season."""
    seasons = master.select("season").distinct().withColumn("_listed", F.lit(True))
    entries = master.withColumnRenamed("element_id", "player_source_id")
    joined = summary.join(entries, KEY, "left").join(seasons, "season", "left")
    matched = F.col("code").isNotNull()
    no_list, no_entry = REVIEW_REASONS[:2]
    return joined.withColumns({
        "mapping_method": F.when(matched, EXACT).otherwise(UNMATCHED),
        "confidence_score": F.when(matched, 1.0).otherwise(0.0),
        "_join_reason": F.when(F.col("_listed").isNull(), no_list).when(~matched, no_entry),
    }).drop("_listed")


def conflict_flags(joined: DataFrame) -> DataFrame:
    """Review reasons in a fixed order, joined by '; '.

    Spreads are aggregates per key, joined back; whether a key has several values is told by its least and greatest one.
    Rows without a code have no part in the joins on codes, so they never meet in one task.
    """
    rows = joined.withColumns({"normalized_name": normalize_name("player_name"), "_raw": normalize_name("name_raw")})

    def several(column: str):
        return F.coalesce(F.min(column) != F.max(column), F.lit(False))

    per_source = rows.groupBy(*KEY).agg((F.count("*") > 1).alias("_same_source"))
    coded = rows.filter(F.col("code").isNotNull())
    per_code = coded.groupBy("code").agg(several("normalized_name").alias("_names"))
    per_season_code = coded.groupBy("season", "code").agg(
        (F.count("*") > 1).alias("_same_code"), several("normalized_name").alias("_season_names"), several("team_name").alias("_teams"),
    )
    flags = ("_names", "_same_code", "_season_names", "_teams")
    with_code = coded.join(per_season_code, ["season", "code"]).join(per_code, "code")
    without = rows.filter(F.col("code").isNull()).withColumns({c: F.lit(False) for c in flags})
    wide = with_code.unionByName(without).join(per_source, KEY, "left")

    def differ(left, right):
        return F.col("code").isNotNull() & (left != "") & (right != "") & (left != right)

    conditions = (
        F.col("_same_source"), F.col("_same_code"), F.col("_names"), F.col("_season_names"),
        differ(F.col("normalized_name"), F.col("_raw")), differ(F.upper(F.trim("position")), F.upper(F.trim("position_raw"))),
        F.col("distinct_team_names") > 1, F.col("distinct_positions") > 1, F.col("_teams"),
    )
    reason = F.concat_ws("; ", F.col("_join_reason"), *[F.when(c, name) for c, name in zip(conditions, REVIEW_REASONS[2:])])
    return wide.withColumns({
        "review_reason": F.when(reason != "", reason), "needs_manual_review": reason != "",
    }).drop("_join_reason", "_raw", "_same_source", *flags)


def identity_map(flagged: DataFrame) -> DataFrame:
    """The map itself; the canonical key is the code as text."""
    name = F.col("normalized_name")
    return flagged.select(
        F.when(F.col("mapping_method") == EXACT, F.col("code").cast("string")).alias("canonical_key"),
        "code", "season", "player_source_id", "player_name", F.when(name == "", "unknown").otherwise(name).alias("normalized_name"),
        "team_name", "position", "first_gameweek", "last_gameweek", "row_count", "minutes_total", "points_total",
        "mapping_method", "confidence_score", "needs_manual_review", "review_reason",
    )


def map_checks(mapping: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """Post-checks: size, history rows without an entry, rows the map stands for."""
    known = history.filter(is_present("player_source_id"))
    return {
        "map": mapping.agg(
            F.count("*").alias("map_rows"), F.sum("row_count").alias("represented_rows"),
            F.count_if(F.col("canonical_key").isNull()).alias("without_key"), F.count_if("needs_manual_review").alias("to_review"),
        ),
        "history": known.join(mapping.select(*KEY), KEY, "left_anti").agg(F.count("*").alias("orphan_rows")),
    }
