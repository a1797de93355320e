"""Results files: one row per match, day-first dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.functions.scalars import is_present, lenient_number, outcome
from pastward.operators.quality import require_columns
from pastward.sources.readers import completed_only

# The columns of the file format.
REQUIRED = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"]
OPTIONAL = ["Time"]
COMPLETED = ["FTHG", "FTAG", "FTR"]


def day_first_date(text) -> Column:
    """Date from d/m/yyyy or d/m/yy text; NULL where it does not parse."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    long, short = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    return F.to_date(
        F.when(long, F.try_to_timestamp(t, F.lit("d/M/yyyy"))).when(short, F.try_to_timestamp(t, F.lit("d/M/yy")))
    )


def parse_results(df: DataFrame, season: str, team_names: dict[str, str] | None = None, keep_raw: bool = False) -> DataFrame:
    """Typed rows of completed matches with ``validation_error`` (NULL for a good row).

    A row without goals or result is not completed and is left out; a completed one without a date or a team is an
    error. With ``team_names`` a name outside the mapping is an error; with ``keep_raw`` the source row stays as JSON.
    """
    require_columns(df, REQUIRED)
    raw = F.to_json(F.struct(*df.columns))
    rows = completed_only(df.withColumn("raw_row_json", raw), COMPLETED)
    home, away = F.trim("HomeTeam"), F.trim("AwayTeam")
    if team_names is not None:
        lookup = F.create_map(*[F.lit(x) for pair in team_names.items() for x in pair])
        mapped = F.element_at(lookup, home), F.element_at(lookup, away)
    else:
        mapped = home, away
    time = F.trim("Time") if "Time" in df.columns else F.lit(None).cast("string")
    kickoff = F.when(
        is_present(time), F.try_to_timestamp(F.concat_ws(" ", F.date_format("match_date", "yyyy-MM-dd"), time), F.lit("yyyy-MM-dd H:mm"))
    )
    typed = rows.withColumns({
        "match_date": day_first_date("Date"),
        "home_goals": lenient_number("FTHG", "int"),
        "away_goals": lenient_number("FTAG", "int"),
        "home_team": mapped[0],
        "away_team": mapped[1],
        "source_result": F.upper(F.trim("FTR")),
    }).withColumns({"kickoff_time": kickoff, "result": outcome("home_goals", "away_goals")})
    errors = [
        F.when(F.col("match_date").isNull(), "unparseable date"),
        F.when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), "non-numeric goals"),
        F.when(~is_present("HomeTeam") | ~is_present("AwayTeam"), "missing team name"),
        F.when(is_present("HomeTeam") & F.col("home_team").isNull() | is_present("AwayTeam") & F.col("away_team").isNull(), "unknown team name"),
        F.when(~F.col("source_result").isin("H", "D", "A"), "invalid result"),
        F.when(F.col("source_result").isin("H", "D", "A") & (F.col("source_result") != F.col("result")), "result does not match goals"),
        F.when(is_present(time) & F.col("kickoff_time").isNull(), "unparseable time"),
    ]
    error = F.concat_ws("; ", *errors)
    return typed.select(
        F.lit(season).alias("season"), "match_date", "kickoff_time", "home_team", "away_team", "home_goals", "away_goals", "result",
        *(["raw_row_json"] if keep_raw else []), F.when(error != "", error).alias("validation_error"),
    )


def strict(df: DataFrame) -> DataFrame:
    """Fail while the rows are read when a row carries a validation error."""
    ok = F.assert_true(F.col("validation_error").isNull(), F.col("validation_error"))
    return df.filter(ok.isNull()).drop("validation_error")


def read_results_csv(spark: SparkSession, path, season: str, team_names: dict[str, str] | None = None) -> DataFrame:
    """Completed matches of a season; any bad row fails the read."""
    return strict(parse_results(spark.read.option("header", True).csv(path), season, team_names))


def validate_snapshot(df: DataFrame, required: list[str], team_columns: list[str]) -> DataFrame:
    """Missing values and unmapped teams of a snapshot as (check, rows); missing columns raise."""
    from pastward.operators.quality import named_counts

    require_columns(df, required)
    counts = {"rows": F.count("*")} | {f"missing_{c}": F.count_if(F.col(c).isNull()) for c in required}
    counts |= {f"unmapped_{c}": F.count_if(~is_present(c)) for c in team_columns}
    return named_counts(df, counts)


def read_tenures(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Tenures from CSV: (usable rows, rejected rows with the reason)."""
    return parse_tenures(spark.read.option("header", True).csv(path))


def parse_tenures(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tenures from text columns: (usable rows, rejected rows with the reason). Blank template rows are in neither."""
    columns = ["team_name", "manager_name", "start_date", "end_date", "source_note"]
    require_columns(raw, columns)
    text = raw.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns])
    filled = text.filter(F.concat("manager_name", "start_date", "end_date", "source_note") != "")

    def iso(c: str) -> Column:
        return F.to_date(F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))

    rows = filled.withColumns({"_start": iso("start_date"), "_end": iso("end_date")})
    reason = F.concat_ws(
        "; ",
        F.when(F.col("team_name") == "", "missing team"), F.when(F.col("manager_name") == "", "missing manager"),
        F.when(F.col("_start").isNull(), "bad start date"), F.when((F.col("end_date") != "") & F.col("_end").isNull(), "bad end date"),
        F.when(F.col("_start") > F.col("_end"), "ends before it starts"),
    )
    checked = rows.withColumn("validation_error", reason)
    good = checked.filter(F.col("validation_error") == "").select(
        "team_name", "manager_name", F.col("_start").alias("start_date"), F.col("_end").alias("end_date"), "source_note"
    )
    return good, checked.filter(F.col("validation_error") != "").select(*columns, "validation_error")
