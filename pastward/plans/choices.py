"""Squad selection, scalar rules and table changes."""

from pyspark.sql import functions as F

from pastward.functions import scalars
from pastward.operators import joins, selection, upsert
from pastward.operators.decisions import argmax_label
from pastward.operators.history import latest_by
from pastward.operators.models import feature_row
from pastward.operators.ranking import top_k
from pastward.plans.common import rounded
from pastward.plans.registry import query
from pastward.sources.readers import completed_only

# ---- selection -----------------------------------------------------------------------


@query("I3", """
SELECT p.* FROM candidates p WHERE (SELECT count(*) FROM candidates q WHERE q.team_id = p.team_id AND q.position = p.position AND q.player_id <> p.player_id
 AND q.expected_points >= p.expected_points AND q.now_cost <= p.now_cost
 AND (q.expected_points > p.expected_points OR q.now_cost < p.now_cost OR q.player_id < p.player_id)) < 3""")
def undominated_players(tables):
    return selection.undominated(tables.candidates, ["team_id", "position"], "now_cost", "expected_points", "player_id")


_SQUAD = "CAST(player_id // 15 AS BIGINT)"
_QUOTA = " AND ".join(f"position_{p} = {n}" for p, n in selection.QUOTAS.items())


# The eleven best of a squad start.
_STARTERS = f"""SELECT * FROM (SELECT *, {_SQUAD} AS squad FROM candidates)
 QUALIFY row_number() OVER (PARTITION BY squad ORDER BY expected_points DESC, player_id) <= 11"""


def squads(tables):
    return tables.candidates.withColumn("squad", F.floor(F.col("player_id") / 15))


def starters(tables):
    return top_k(squads(tables), ["squad"], [F.col("expected_points").desc(), F.col("player_id")], 11)


@query("I4", f"""
WITH s AS (SELECT *, {_SQUAD} AS squad FROM candidates), t AS (SELECT squad, team_id, count(*) AS n FROM s GROUP BY squad, team_id),
q AS (SELECT s.squad, count(*) AS players, {', '.join(f'count(*) FILTER (position = {p}) AS position_{p}' for p in selection.QUOTAS)},
 (SELECT max(n) FROM t WHERE t.squad = s.squad) AS most_per_team, CAST(sum(now_cost) AS BIGINT) AS cost, round(sum(expected_points), 6) AS points FROM s GROUP BY s.squad)
SELECT *, players = 15 AND most_per_team <= 3 AND cost <= 1000 AND {_QUOTA} AS allowed FROM q""")
def squad_check(tables):
    return rounded(selection.squad_check(squads(tables), "squad"))


_FORM = " AND ".join(f"position_{p} BETWEEN {a} AND {b}" for p, (a, b) in selection.FORMATION.items())


@query("I5", f"""
WITH s AS ({_STARTERS}),
q AS (SELECT squad, count(*) AS starters, {', '.join(f'count(*) FILTER (position = {p}) AS position_{p}' for p in selection.FORMATION)} FROM s GROUP BY squad)
SELECT *, starters = 11 AND {_FORM} AS valid FROM q""")
def starting_eleven_check(tables):
    return selection.formation_check(starters(tables), "squad")


@query("I6 C20", f"""
WITH s AS (SELECT player_id, squad, round(expected_points + 0.4 * (now_cost % 9), 6) AS captain_score FROM ({_STARTERS}))
SELECT squad, player_id, captain_score, CASE row_number() OVER w WHEN 1 THEN 'captain' ELSE 'vice_captain' END AS role FROM s
WINDOW w AS (PARTITION BY squad ORDER BY captain_score DESC, player_id) QUALIFY row_number() OVER w <= 2""")
def captains(tables):
    rows = starters(tables).withColumn("form", F.col("now_cost") % 9)
    rows = rows.withColumn("captain_score", F.round(selection.captain_score("expected_points", "form"), 6))
    return selection.captains(rows, "squad", "captain_score", "player_id")


@query("I7 I10", f"""
WITH c AS (SELECT *, now_cost % 4 > 0 AS available, position <> 4 OR now_cost >= 88 AS playing FROM candidates),
e AS (SELECT {' AND '.join(f'count(*) FILTER (available AND playing AND position = {p}) >= {n}' for p, n in selection.QUOTAS.items())} AS strict_ok FROM c)
SELECT player_id, position, CASE WHEN strict_ok THEN 'strict' ELSE 'available' END AS pool FROM c, e WHERE available AND (playing OR NOT strict_ok)""")
def candidate_pool(tables):
    available = F.col("now_cost") % 4 > 0
    playing = (F.col("position") != 4) | (F.col("now_cost") >= 88)
    return selection.candidate_pool(tables.candidates, available, playing).select("player_id", "position", "pool")


# Player sheet: news and recent form derived from parts.
_SHEET = """
sheet AS (SELECT p_partkey AS player_id, CAST(p_partkey % 5 AS INT) AS position,
 CASE p_size % 6 WHEN 0 THEN 'a' WHEN 1 THEN ' I ' WHEN 2 THEN 'd' WHEN 3 THEN 's' WHEN 4 THEN 'u' END AS status,
 CASE WHEN p_size % 5 > 0 THEN CASE p_size % 5 WHEN 4 THEN 'n/a' ELSE CAST(p_size * 3 AS VARCHAR) END END AS chance_text,
 CASE WHEN p_size % 7 = 0 THEN CAST(75 AS INT) END AS chance_next, CASE WHEN p_size % 3 = 0 THEN CAST(25 AS INT) END AS chance_this,
 CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 8 > 0 END AS is_available,
 CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_partkey % 91 AS DOUBLE) END AS minutes_last5, CAST(p_partkey % 11 AS DOUBLE) / 10 AS starts_last5,
 CAST(p_partkey % 17 * 50 AS DOUBLE) AS season_minutes, CAST(p_partkey % 6 AS INT) AS matches_last5, CAST(floor(p_retailprice) AS DOUBLE) / 200 AS points,
 CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size % 10 AS DOUBLE) / 2 END AS form, CAST(p_partkey % 15 AS INT) AS clean_sheets, CAST(p_partkey % 10 AS DOUBLE) / 10 AS minutes_ratio,
 CAST(p_partkey % 8 AS INT) AS goals_scored, CAST(p_partkey % 5 AS INT) AS assists FROM part)"""


def sheet(tables):
    body = _SHEET.strip().removeprefix("sheet AS (").removesuffix(")").replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}")
    return tables.spark.sql(body, part=tables.read("part"))


@query("C16 I8", f"""
WITH {_SHEET} SELECT player_id, CASE WHEN lower(trim(status)) IN ('i', 'n', 's', 'u') THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(TRY_CAST(chance_text AS DOUBLE), 100.0) / 100)) END AS availability,
 round(points * CASE WHEN lower(trim(status)) IN ('i', 'n', 's', 'u') THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(TRY_CAST(chance_text AS DOUBLE), 100.0) / 100)) END, 6) AS expected_points FROM sheet""")
def availability_and_expected_points(tables):
    rows = sheet(tables).select("player_id", "points", selection.availability("chance_text", "status").alias("availability"))
    return rounded(rows.select("player_id", "availability", (F.col("points") * F.col("availability")).alias("expected_points")))


@query("C17", f"""
WITH {_SHEET}, b AS (SELECT *, lower(trim(status)) AS st, coalesce(minutes_last5, 0) AS m, coalesce(starts_last5, 0) AS s5, coalesce(season_minutes, 0) AS sm FROM sheet),
x AS (SELECT *, CASE WHEN chance_next IS NOT NULL THEN chance_next / 100 WHEN chance_this IS NOT NULL THEN chance_this / 100 WHEN st = 'a' OR st IS NULL THEN 0.95 ELSE 0.5 END
 + CASE WHEN s5 >= 0.8 OR m >= 70 THEN 0.05 ELSE 0 END - CASE WHEN m < 30 AND sm > 0 THEN 0.1 ELSE 0 END AS base FROM b)
SELECT player_id, round(CASE WHEN NOT coalesce(is_available, false) OR coalesce(st, '') IN ('i', 's') THEN 0.0::DOUBLE
 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN sm = 0 THEN least(base, 0.2::DOUBLE) ELSE base END)) END, 6) AS start_probability FROM x""")
def start_probability(tables):
    rows = sheet(tables)
    return rounded(rows.select("player_id", selection.start_probability(rows).alias("start_probability")))


@query("C18", f"""
WITH {_SHEET}, b AS (SELECT *, coalesce(season_minutes, 0) >= 90 OR coalesce(minutes_last5, 0) >= 20 OR coalesce(starts_last5, 0) >= 0.4 AS cand FROM sheet),
c AS (SELECT *, CASE WHEN cand THEN points ELSE least(points, 0.5) END AS v1 FROM b), d AS (SELECT *, CASE WHEN matches_last5 < 3 THEN least(v1, 1.0) ELSE v1 END AS v2 FROM c)
SELECT player_id, cand AS is_playing_candidate, round(CASE WHEN coalesce(is_available, false) THEN v2 ELSE 0.0 END, 6) AS points FROM d""")
def sanity_capped_points(tables):
    return rounded(selection.sanity_capped(sheet(tables), "points").select("player_id", "is_playing_candidate", "points"))


@query("C19", f"""
WITH {_SHEET} SELECT player_id, round(CASE WHEN coalesce(is_available, false) THEN coalesce(form, 0) + CASE position WHEN 1 THEN clean_sheets * 6 * minutes_ratio
 WHEN 2 THEN goals_scored * 6 + assists * 3 + clean_sheets * 6 * minutes_ratio WHEN 3 THEN goals_scored * 5 + assists * 3 WHEN 4 THEN goals_scored * 4 + assists * 3 ELSE 0.0 END / 38 ELSE 0.0 END, 6) AS points FROM sheet""")
def rule_points(tables):
    return rounded(sheet(tables).select("player_id", selection.rule_points().alias("points")))


# ---- scalars -------------------------------------------------------------------------


@query("C1 C2 C3", """
SELECT match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result, CAST(home_goals > away_goals AS INT) AS home_win,
 CAST(home_goals = away_goals AS INT) AS is_draw, CAST(home_goals < away_goals AS INT) AS away_win,
 CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS home_points, event_time FROM matches WHERE kickoff_time IS NOT NULL""")
def match_results(tables):
    result = scalars.outcome("home_goals", "away_goals")
    return tables.matches.filter(F.col("kickoff_time").isNotNull()).select(
        "match_id", result.alias("result"), (result == "H").cast("int").alias("home_win"), (result == "D").cast("int").alias("is_draw"),
        (result == "A").cast("int").alias("away_win"), scalars.points_for("home_goals", "away_goals").alias("home_points"), "event_time",
    )


@query("C4", "SELECT match_id, venue, team, opponent, goals_for, goals_against, xg_for, xg_against FROM team_rows")
def team_perspective_rows(tables):
    return tables.team_rows.select("match_id", "venue", "team", "opponent", "goals_for", "goals_against", "xg_for", "xg_against")


@query("C5 C6 C13 C14", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(CAST(l_extendedprice AS DOUBLE) / nullif(l_linenumber - 3, 0) AS DECIMAL(38,10)), 2) AS DOUBLE) AS value_ratio,
 coalesce(CAST(round(CAST(CAST(l_extendedprice AS DOUBLE) / nullif(l_linenumber - 3, 0) AS DECIMAL(38,10)), 2) AS DOUBLE), 0.0) AS value_or_zero,
 CASE WHEN l_linenumber <> 3 THEN least(5000.0, greatest(1000.0, CAST(l_extendedprice AS DOUBLE))) END AS clipped,
 greatest(CASE WHEN l_linenumber <> 3 THEN l_linenumber END, CASE WHEN l_linenumber > 5 THEN 6 END) AS larger,
 CASE WHEN l_linenumber <> 3 THEN l_linenumber END - CASE WHEN l_linenumber > 5 THEN 6 END AS difference FROM lineitem""")
def guarded_arithmetic(tables):
    line = F.col("l_linenumber")
    price = F.col("l_extendedprice").cast("double")
    some, high = F.when(line != 3, line), F.when(line > 5, 6)
    value = scalars.ratio(price, line - 3, 2)
    return tables.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", value.alias("value_ratio"), F.coalesce(value, F.lit(0.0)).alias("value_or_zero"),
        scalars.clip(F.when(line != 3, price), 1000.0, 5000.0).alias("clipped"), scalars.max_or_null(some, high).alias("larger"),
        scalars.diff_or_null(some, high).alias("difference"),
    )


_NAMES = "CASE c_nationkey % 4 WHEN 0 THEN upper(c_name) || ' 12' WHEN 1 THEN '  ' || c_name || '_x ' WHEN 2 THEN 'Zoë D''Éclair & ' || c_name ELSE c_name END"


@query("C7 C8 C9", f"""
WITH n AS (SELECT c_custkey, c_name, {_NAMES} AS name FROM customer)
SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), ' [0-9]+$', '')) AS normalized,
 replace(regexp_replace(lower(name), '[''. ]', '', 'g'), '&', 'and') AS text_key, lower(name) = lower(c_name) AS same FROM n""")
def text_normalisation(tables):
    nation = F.col("c_nationkey") % 4
    name = F.when(nation == 0, F.concat(F.upper("c_name"), F.lit(" 12"))).when(nation == 1, F.concat(F.lit("  "), "c_name", F.lit("_x "))).when(
        nation == 2, F.concat(F.lit("Zoë D'Éclair & "), "c_name")
    ).otherwise(F.col("c_name"))
    rows = tables.read("customer").select("c_custkey", "c_name", name.alias("name"))
    return rows.select(
        "c_custkey", scalars.normalize_name("name").alias("normalized"), scalars.text_key("name").alias("text_key"),
        scalars.same_text("name", "c_name").alias("same"),
    )


@query("C10", """
SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS state FROM orders""")
def mapped_status(tables):
    rows = tables.read("orders").select("o_orderkey", "o_orderstatus")
    return joins.map_values(rows, "o_orderstatus", {"F": "finished", "O": "open", "P": "partial"}, "state")


@query("C10", "SELECT m.match_id, m.home_team, n.n_name AS home_name FROM matches m JOIN nation n ON n.n_nationkey = m.home_team")
def mapped_team_names(tables):
    names = tables.read("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    return joins.map_strict(tables.matches.select("match_id", "home_team"), "home_team", names, "n_nationkey", "n_name", "home_name")


@query("C11", """
WITH known AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) ELSE s_name END AS k FROM supplier WHERE s_acctbal > 0),
ask AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN replace(s_name, '#', ' .#') WHEN 2 THEN 'Alias ' || s_name ELSE upper(s_name) END AS name FROM supplier),
ali AS (SELECT 'Alias ' || s_name AS name, s_name AS alias FROM supplier),
r AS (SELECT a.s_suppkey, a.name, e.k AS ex, (SELECT min(k2.k) FROM ali JOIN known k2 ON k2.k = ali.alias WHERE ali.name = a.name) AS al,
 (SELECT min(k3.k) FROM known k3 WHERE replace(regexp_replace(lower(k3.k), '[''. ]', '', 'g'), '&', 'and') = replace(regexp_replace(lower(a.name), '[''. ]', '', 'g'), '&', 'and')) AS si
 FROM ask a LEFT JOIN known e ON e.k = a.name)
SELECT s_suppkey, name, coalesce(ex, al, si, name) AS resolved_name, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN al IS NOT NULL THEN 'alias' WHEN si IS NOT NULL THEN 'normalized' ELSE 'new' END AS resolved_by,
 ex IS NULL AND al IS NULL AND si IS NULL AS cold_start FROM r""")
def resolved_names(tables):
    supplier = tables.read("supplier")
    key, name = F.col("s_suppkey"), F.col("s_name")
    known = supplier.filter("s_acctbal > 0").select(F.when(key % 3 == 0, F.lower(name)).otherwise(name).alias("k"))
    asked = F.when(key % 4 == 0, name).when(key % 4 == 1, F.replace(name, F.lit("#"), F.lit(" .#"))).when(key % 4 == 2, F.concat(F.lit("Alias "), name)).otherwise(F.upper(name))
    aliases = supplier.select(F.concat(F.lit("Alias "), name).alias("name"), name.alias("alias"))
    return joins.resolve_entity(supplier.select("s_suppkey", asked.alias("name")), "name", known, "k", aliases)


_ARG = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END"


@query("C15", f"""
WITH a AS (SELECT match_id, {_ARG} AS result, home_goals, away_goals FROM preds)
SELECT match_id, result, CASE WHEN result = 'H' AND home_goals <= away_goals THEN away_goals + 1 WHEN result = 'D' THEN CAST(floor((home_goals + away_goals) / 2) AS INT) ELSE home_goals END AS home_score,
 CASE WHEN result = 'A' AND away_goals <= home_goals THEN home_goals + 1 WHEN result = 'D' THEN CAST(floor((home_goals + away_goals) / 2) AS INT) ELSE away_goals END AS away_score FROM a""")
def aligned_scores(tables):
    rows = tables.preds.select("match_id", argmax_label().alias("result"), "home_goals", "away_goals")
    home, away = scalars.align_score("result", "home_goals", "away_goals")
    return rows.select("match_id", "result", home.alias("home_score"), away.alias("away_score"))


@query("C21", "SELECT row_id, coalesce(CAST(xg AS DOUBLE), 0.0) AS xg, coalesce(CAST(minutes AS DOUBLE), 0.0) AS minutes, 0.0::DOUBLE AS absent_feature FROM player_rows")
def feature_rows(tables):
    return feature_row(tables.player_rows, ["xg", "minutes", "absent_feature"], ["row_id"])


@query("C22", """
SELECT row_id, season, player_source_id, team_name FROM history WHERE player_source_id IS NOT NULL AND trim(player_source_id) <> '' AND team_name IS NOT NULL AND trim(team_name) <> ''
 AND total_points IS NOT NULL""")
def completed_rows_only(tables):
    return completed_only(tables.history, ["player_source_id", "team_name", "total_points"]).select("row_id", "season", "player_source_id", "team_name")


@query("A15", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS INT) AS missing FROM events")
def json_integers(tables):
    return tables.read("events").select("event_id", scalars.json_int("props", "k").alias("k"), scalars.json_int("props", "missing").alias("missing"))


@query("B9 C12", "SELECT DISTINCT season, make_date(season, 8, 1) AS starts_on, make_date(season + 1, 5, 31) AS ends_on FROM matches")
def season_reference_rows(tables):
    start, end = scalars.season_bounds(F.col("season"))
    return tables.matches.select("season").distinct().select("season", start.alias("starts_on"), end.alias("ends_on"))


# ---- table changes -------------------------------------------------------------------

# The stored table holds the newest row per player up to 1998; the source brings the rows of 1999 on.
_STORED = """
stored AS (SELECT player_id, run_id, snapshot_id, status, now_cost FROM snapshots WHERE run_id <= 1998 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY run_id DESC, snapshot_id DESC) = 1),
source AS (SELECT player_id, run_id, snapshot_id, CASE WHEN status <> 'P' THEN status END AS status, now_cost FROM snapshots WHERE run_id >= 1999)"""


def stored_and_source(tables):
    rows = tables.snapshots.select("player_id", "run_id", "snapshot_id", "status", "now_cost")
    stored = latest_by(rows.filter("run_id <= 1998"), ["player_id"], ["run_id", "snapshot_id"])
    source = rows.filter("run_id >= 1999").withColumn("status", F.when(F.col("status") != "P", F.col("status")))
    return stored, source


@query("B3", f"""
WITH {_STORED} SELECT * FROM stored UNION ALL SELECT * FROM (SELECT * FROM source WHERE player_id NOT IN (SELECT player_id FROM stored)
 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY run_id, snapshot_id) = 1)""")
def insert_if_absent(tables):
    stored, source = stored_and_source(tables)
    return upsert.insert_if_absent(stored, source, ["player_id"], ["run_id", "snapshot_id"])


@query("B3", f"""
WITH {_STORED} SELECT count(*) AS source_rows, count(DISTINCT player_id) FILTER (player_id NOT IN (SELECT player_id FROM stored)) AS inserted,
 count(*) - count(DISTINCT player_id) FILTER (player_id NOT IN (SELECT player_id FROM stored)) AS skipped FROM source""")
def inserted_counts(tables):
    stored, source = stored_and_source(tables)
    return upsert.insert_counts(stored, source, ["player_id"])


@query("B4", f"""
WITH {_STORED}, s AS (SELECT * FROM source QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY run_id DESC, snapshot_id DESC) = 1)
SELECT coalesce(t.player_id, s.player_id) AS player_id, CASE WHEN s.player_id IS NOT NULL THEN s.run_id ELSE t.run_id END AS run_id, CASE WHEN t.player_id IS NOT NULL THEN t.snapshot_id ELSE s.snapshot_id END AS snapshot_id,
 CASE WHEN s.player_id IS NOT NULL THEN s.status ELSE t.status END AS status, CASE WHEN s.player_id IS NOT NULL THEN s.now_cost ELSE t.now_cost END AS now_cost FROM stored t FULL JOIN s ON s.player_id = t.player_id""")
def upserted_players(tables):
    stored, source = stored_and_source(tables)
    return upsert.upsert(stored, source, ["player_id"], ["run_id", "status", "now_cost"], order=["run_id", "snapshot_id"])


@query("B5", """
WITH p AS (SELECT match_id, CASE WHEN season < 1997 THEN 'X' END AS scored_as, CASE WHEN season < 1997 THEN match_date END AS scored_on FROM matches),
s AS (SELECT match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS scored_as, match_date AS scored_on FROM matches WHERE season <= 1999)
SELECT p.match_id, CASE WHEN s.match_id IS NOT NULL AND p.scored_on IS NULL THEN s.scored_as ELSE p.scored_as END AS scored_as,
 CASE WHEN s.match_id IS NOT NULL AND p.scored_on IS NULL THEN s.scored_on ELSE p.scored_on END AS scored_on FROM p LEFT JOIN s ON s.match_id = p.match_id""")
def scores_applied(tables):
    done = F.col("season") < 1997
    stored = tables.matches.select("match_id", F.when(done, F.lit("X")).alias("scored_as"), F.when(done, F.col("match_date")).alias("scored_on"))
    scored = tables.matches.filter("season <= 1999").select(
        "match_id", scalars.outcome("home_goals", "away_goals").alias("scored_as"), F.col("match_date").alias("scored_on")
    )
    return upsert.apply_scores(stored, scored, "match_id", ["scored_as", "scored_on"], "scored_on")


@query("B5", """
SELECT count(*) AS given, count(*) FILTER (season BETWEEN 1997 AND 1999) AS applied, count(*) FILTER (season < 1997) AS scored_before, CAST(0 AS BIGINT) AS unknown FROM matches WHERE season <= 1999""")
def applied_score_counts(tables):
    stored = tables.matches.select("match_id", F.when(F.col("season") < 1997, F.col("match_date")).alias("scored_on"))
    return upsert.score_counts(stored, tables.matches.filter("season <= 1999").select("match_id"), "match_id", "scored_on")
