"""Player files, one per season and period, whose columns drift over the years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.functions.scalars import blank_to_null, lenient_boolean, lenient_number

# Accepted source columns per canonical column, first existing one wins.
TEXT = {
    "player_source_id": ["element", "player_id", "id"],
    "player_name": ["player_name", "name", "web_name"],
    "player_slug": ["player_slug", "slug", "cleaned_name"],
    "team_name": ["team_name", "team"],
    "opponent_team_name": ["opponent_team_name", "opponent_team"],
    "fixture_id": ["fixture_id", "fixture"],
    "position": ["position", "element_type", "element_type_name"],
    "raw_player_key": ["raw_player_key", "element", "player_id", "id", "name"],
}
TIMES = {"kickoff_time": ["kickoff_time", "kickoff"]}
BOOLEANS = {"was_home": ["was_home"]}
INTEGERS = ["minutes", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "bonus", "bps", "starts", "value"]
NUMBERS = ["influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "selected"]


# Possessive throughout, so that Java matches in a loop and not by recursion.
_QUOTED = r'"(?:[^"]++|"")*+"'
_CELL = rf"(?:{_QUOTED}(?:[^,\r\n]|\r(?!\n))*+|(?:[^,\r\n]|\r(?!\n))*+)"
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\r?\n|\z)"
_FIELD = rf"(?:^|(?<=,))({_QUOTED}[^,]*+|[^,]*+)"


def records(text: Column) -> Column:
    """Lines of comma-separated text; a line break inside quotes does not end one."""
    return F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))


def fields(line: Column) -> Column:
    """Values of one line of comma-separated text; quotes around a value are taken off."""
    found = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    return F.transform(found, lambda v: F.when(v.rlike(rf"\A{_QUOTED}\z"), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), '""', '"')).otherwise(v))


def canonical_names(header: Column) -> Column:
    """Column names in lower case, their words (letters and digits) joined by one underscore."""
    words = F.transform(header, lambda name: F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.transform(words, lambda w: F.array_join(w, "_"))


def period_rows(rows: DataFrame, season: Column, period: Column, source_file: Column) -> DataFrame:
    """One canonical schema from rows (header, values) of any of the known layouts; unreadable values become NULL.

    ``header`` holds canonical names. A name that a header repeats means its first column.
    """

    def value(name: str) -> Column:
        return F.get("values", (F.array_position("header", F.lit(name)) - 1).cast("int"))

    def has(name: str) -> Column:
        return F.array_contains("header", name)

    def pick(candidates: list[str]) -> Column:
        return F.coalesce(*[F.when(has(c), F.struct(value(c).alias("v"))) for c in candidates])["v"]

    text = {name: blank_to_null(pick(candidates)) for name, candidates in TEXT.items()}
    full = blank_to_null(F.concat(F.coalesce(value("first_name"), F.lit("")), F.lit(" "), F.coalesce(value("second_name"), F.lit(""))))
    two_part = ~has("player_name") & ~has("name") & has("first_name") & has("second_name")
    text["player_name"] = F.when(two_part, full).otherwise(text["player_name"])
    columns = {"season": season, "gameweek": period.cast("int")} | text
    columns |= {name: pick(c).try_cast("timestamp") for name, c in TIMES.items()}
    columns |= {name: lenient_boolean(pick(c)) for name, c in BOOLEANS.items()}
    columns |= {name: lenient_number(pick([name]), "int") for name in INTEGERS}
    columns |= {name: lenient_number(pick([name])) for name in NUMBERS}
    return rows.select(*[v.alias(k) for k, v in columns.items()], source_file.alias("source_file"))


def read_period_files(spark: SparkSession, root: str) -> DataFrame:
    """All files <season>/…/gw<period>.csv below a folder, as canonical rows.

    Every file is read once, whole: one season and period is a few hundred lines. Each line is taken apart by its own
    file's header, so any number of layouts is one plan and nothing reaches the driver.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[gG][wW]*.csv")
    return parsed_files(reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_files(files: DataFrame) -> DataFrame:
    """Canonical rows of files given as (path, value), value being all of a file's text.

    A path without a season, or without a period from 1 on, fails while it is read.
    """
    files = files.select(records(F.regexp_replace("value", "^\ufeff", "")).alias("lines"), "path")
    for pattern, what in ((r"/\d{4}-\d{2}/", "season"), (r"(?i)/gw0*[1-9]\d*\.csv$", "period")):
        files = files.filter(F.assert_true(F.col("path").rlike(pattern), F.concat(F.lit(f"no {what} in the path "), F.col("path"))).isNull())
    body = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda line: F.trim(line) != "")
    lines = files.select("path", canonical_names(fields(F.get("lines", F.lit(0)))).alias("header"), F.explode(body).alias("line"))
    rows = lines.select("path", "header", fields(F.col("line")).alias("values"))
    return period_rows(
        rows, F.regexp_extract("path", r"/(\d{4}-\d{2})/", 1), F.regexp_extract("path", r"(?i)/gw(\d+)\.csv$", 1), F.regexp_extract("path", r"(\d{4}-\d{2}/.*)$", 1))
