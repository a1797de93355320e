"""Readers and parsers on small files written here."""

import datetime as dt
import json

import pytest
from result_rows import collected
from pyspark.sql import functions as F

from pastward.sources import payloads, period_files, results
from pastward.sources.readers import filter_by


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


HEADER = "Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n"


def test_results_csv(spark, tmp_path):
    path = write(tmp_path / "r.csv", HEADER + "13/08/2021,20:00,A,B,2,0,H\n3/9/21,,B,A,1,1,d\n20/05/2022,15:00,A,B,,,\n")
    got = collected(results.read_results_csv(spark, path, "2021-22", {"A": "Alpha", "B": "Beta"}), "match_date", "kickoff_time", "home_team", "home_goals", "result")
    assert got == [
        (dt.date(2021, 8, 13), dt.datetime(2021, 8, 13, 20, 0), "Alpha", 2, "H"), (dt.date(2021, 9, 3), None, "Beta", 1, "D"),
    ]


@pytest.mark.parametrize("line, error", [
    ("2021-08-13,,A,B,2,0,H", "unparseable date"), ("13/08/2021,,A,B,x,0,H", "non-numeric goals"), ("13/08/2021,,A,C,2,0,H", "unknown team name"),
    ("13/08/2021,,A,B,2,0,A", "result does not match goals"), ("13/08/2021,,A,B,2,0,Q", "invalid result"), ("13/08/2021,noon,A,B,2,0,H", "unparseable time"),
])
def test_bad_result_rows(spark, tmp_path, line, error):
    path = write(tmp_path / "r.csv", HEADER + line + "\n")
    names = {"A": "A", "B": "B"}
    rows = results.parse_results(spark.read.option("header", True).csv(path), "s", names, keep_raw=True)
    row = rows.first()
    assert row.validation_error == error and json.loads(row.raw_row_json)["HomeTeam"] == "A"
    with pytest.raises(Exception, match=error):
        results.read_results_csv(spark, path, "s", names).collect()


def test_results_need_their_columns(spark, tmp_path):
    path = write(tmp_path / "r.csv", "Date,HomeTeam\n1/1/2020,A\n")
    with pytest.raises(ValueError, match="AwayTeam"):
        results.read_results_csv(spark, path, "s")


def test_period_files_with_drifting_columns(spark, tmp_path):
    write(tmp_path / "data/2019-20/gws/gw1.csv", "name,element,Total Points,was_home,minutes,kickoff_time\nJo_Doe,7,5,True,90.0,2019-08-10T14:00:00Z\n ,8,x,no,,bad\n")
    write(tmp_path / "data/2019-20/gws/GW12.csv", "name,element,Total Points,was_home,minutes,kickoff_time\nJo_Doe,7,2,False,12,\n")
    write(tmp_path / "data/2020-21/gws/gw1.csv", "first_name,second_name,id,team,total_points,expected_goals\nJo,Doe,9,Arc,3,0.25\n")
    write(tmp_path / "data/2020-21/players.csv", "a,b\n1,2\n")
    got = collected(period_files.read_period_files(spark, str(tmp_path / "data")),
                    "season", "gameweek", "player_source_id", "player_name", "team_name", "total_points", "was_home", "minutes", "expected_goals", "source_file")
    assert got == sorted([
        ("2019-20", 1, "7", "Jo_Doe", None, 5, True, 90, None, "2019-20/gws/gw1.csv"),
        ("2019-20", 1, "8", None, None, None, False, None, None, "2019-20/gws/gw1.csv"),
        ("2019-20", 12, "7", "Jo_Doe", None, 2, False, 12, None, "2019-20/gws/GW12.csv"),
        ("2020-21", 1, "9", "Jo Doe", "Arc", 3, None, None, 0.25, "2020-21/gws/gw1.csv"),
    ], key=repr)


def test_period_file_quotes_repeated_names_and_missing_season(spark, tmp_path):
    write(tmp_path / "data/2019-20/gw3.csv", '"Name",element,team,Team,minutes\r\n"Doe, ""Jo""",7,"A,B",C,\r\n')
    got = collected(period_files.read_period_files(spark, str(tmp_path / "data")), "season", "gameweek", "player_name", "team_name", "minutes")
    assert got == [("2019-20", 3, 'Doe, "Jo"', "A,B", None)]
    write(tmp_path / "other/gw1.csv", "name,element\nJo,7\n")
    with pytest.raises(Exception, match="no season"):
        period_files.read_period_files(spark, str(tmp_path / "other")).collect()


def test_match_json(rows):
    matches = [
        {"id": "1", "isResult": True, "datetime": "2023-08-11 19:00:00", "h": {"title": "A", "xG": "1.5"}, "a": {"title": "B", "xg": 0.5}, "goals": {"h": "2", "a": "0"}},
        {"id": 2, "isResult": "true", "date": "2023-08-12", "h": {"title": "B"}, "a": {"title": "A"}, "xG": {"h": "0.1", "a": "0.2"}, "goals": {"h": 0, "a": 0}},
        {"id": "3", "isResult": False, "h": {}, "a": {}, "goals": {}},
        {"id": "4", "isResult": 1, "datetime": "2023-08-13", "h": {"title": "A", "xG": "n/a"}, "a": {"title": "B", "xG": 1}, "goals": {"h": "1.5", "a": 1}},
    ]
    df = rows("payload string", (json.dumps(matches),))
    got = {r.feed_match_id: r for r in payloads.parse_match_json(df, "payload", "2023-24").collect()}
    assert set(got) == {"1", "2", "4"}
    assert (got["1"].match_date, got["1"].home_xg, got["1"].away_xg, got["1"].home_goals) == (dt.date(2023, 8, 11), 1.5, 0.5, 2)
    assert (got["2"].home_xg, got["2"].away_xg, got["2"].validation_error) == (0.1, 0.2, None)
    assert got["4"].validation_error == "missing home_xg; missing home_goals"


@pytest.mark.parametrize("as_list", [True, False])
def test_team_history(rows, as_list):
    team = {"id": "83", "title": " Arc ", "history": [
        {"date": "2025-08-17 15:30:00", "h_a": "h", "xG": 1.25, "xGA": "0.5", "ppda": {"att": 100, "def": 8}, "ppda_allowed": {"att": 9, "def": 0}, "scored": 2, "missed": "1", "pts": 3},
        {"date": "bad", "h_a": "a", "xG": "", "ppda": 7.5, "scored": None},
    ]}
    df = rows("payload string", (json.dumps({"teams": [team] if as_list else {"83": team}}),))
    got = collected(payloads.parse_team_history(df, "payload", 2025), "team_id", "team_name", "match_date", "venue", "xg", "xga", "ppda", "ppda_allowed", "scored", "pts")
    assert got == sorted([
        (83, "Arc", dt.date(2025, 8, 17), "h", 1.25, 0.5, 12.5, None, 2, 3), (83, "Arc", None, "a", None, None, 7.5, None, None, None),
    ], key=repr)


BOOT = {
    "events": [{"id": 3, "is_previous": True}, {"id": 4, "is_current": True, "deadline_time": "2025-08-15T17:30:00Z"}, {"id": 5, "is_next": False}],
    "teams": [{"id": 1, "name": "Arc"}, {"id": 2, "short_name": "BET"}],
    "elements": [
        {"id": 10, "first_name": "Jo", "second_name": "Doe", "web_name": "Doe", "team": 1, "element_type": 3, "now_cost": 55, "selected_by_percent": "12.5", "total_points": 8, "form": "2.0", "status": "a", "news": "", "chance_of_playing_next_round": None},
        {"id": 11, "first_name": "", "second_name": None, "web_name": "Mo", "team": 2, "element_type": 1, "now_cost": 40, "total_points": 0, "status": "d", "news": "Knock", "news_added": "2025-08-01T10:00:00+02:00", "chance_of_playing_next_round": 75},
    ],
}


def test_player_snapshot(rows):
    df = rows("payload string", (json.dumps(BOOT),))
    got = {r.player_id: r for r in payloads.parse_player_snapshot(df, "payload").collect()}
    first, second = got[10], got[11]
    assert (first.player_name, first.team_name, first.event_id, first.deadline_time) == ("Jo Doe", "Arc", 4, dt.datetime(2025, 8, 15, 17, 30))
    assert (first.now_cost, first.selected_by_percent, first.news, first.chance_of_playing_next_round) == (55, 12.5, None, None)
    assert (second.player_name, second.team_name, second.news_added, second.chance_of_playing_next_round) == ("Mo", "BET", dt.datetime(2025, 8, 1, 8, 0), 75)
    assert json.loads(first.raw_player_json)["web_name"] == "Doe"


def test_fixture_snapshot(rows):
    fixtures = [{"id": 1, "event": 4, "kickoff_time": "2025-08-15T19:00:00Z", "team_h": 1, "team_a": 2, "finished": False, "started": True, "team_h_score": None},
                {"id": 2, "event": None, "kickoff_time": None, "team_h": 2, "team_a": 9, "finished": True, "started": True, "team_h_score": 1, "team_a_score": 0}]
    df = rows("f string, b string", (json.dumps(fixtures), json.dumps(BOOT)))
    got = collected(payloads.parse_fixture_snapshot(df, "f", "b"), "fixture_id", "event_id", "kickoff_time", "team_h_name", "team_a_name", "finished", "team_h_score")
    assert got == [(1, 4, dt.datetime(2025, 8, 15, 19, 0), "Arc", "BET", False, None), (2, None, None, "BET", None, True, 1)]


def test_live_period(rows):
    live = {"elements": [{"id": 10, "stats": {"minutes": "90", "total_points": 6, "expected_goals": "0.31"}}, {"id": 12, "stats": {}}]}
    identity = rows("player_id int, code int, player_name string, team_id int, position_id int", (10, 777, "Jo Doe", 1, 3))
    got = collected(payloads.parse_live_period(rows("p string", (json.dumps(live),)), "p", identity, "2025-26", 4),
                    "player_id", "player_name", "code", "identity_status", "minutes", "goals_scored", "expected_goals")
    assert got == [(10, "Jo Doe", 777, "matched", 90, 0, 0.31), (12, "12", None, "unmatched", 0, 0, None)]


def test_player_history(rows):
    payload = {"history": [{"fixture": 5, "round": 1, "was_home": True, "kickoff_time": "2025-08-16T11:30:00Z", "minutes": 90, "influence": "12.4"}]}
    row = payloads.parse_player_history(rows("player_id int, p string", (10, json.dumps(payload))), "player_id", "p").first()
    assert (row.player_id, row.gameweek, row.was_home, row.minutes, row.influence, row.bonus) == (10, 1, True, 90, 12.4, None)


def test_clean_players(rows):
    df = rows("id string, element_type string, now_cost string, form string, status string", ("1", "3", "55", "2.5", "a"), ("2", "1", "40", "x", None))
    got = collected(payloads.clean_players(df), "id", "position", "now_cost", "form", "is_available", "news")
    assert got == [(1, 3, 5.5, 2.5, True, None), (2, 1, 4.0, None, False, None)]
    assert len(payloads.clean_players(df).columns) == 29


def test_tenures(spark, tmp_path):
    path = write(tmp_path / "t.csv", "team_name,manager_name,start_date,end_date,source_note\nArc,Mo,2020-01-01,2021-01-01,x\nArc,,,,\nBet,Jo,2020-13-01,,\nBet,Jo,2021-02-01,2020-02-01,\nBet,Al,2021-02-01,,\n")
    good, bad = results.read_tenures(spark, path)
    assert collected(good, "team_name", "end_date") == sorted([("Arc", dt.date(2021, 1, 1)), ("Bet", None)], key=repr)
    assert collected(bad, "validation_error") == [("bad start date",), ("ends before it starts",)]


def test_snapshot_validation(rows):
    df = rows("team_name string, price int", ("A", 1), (" ", None))
    got = dict(collected(results.validate_snapshot(df, ["team_name", "price"], ["team_name"])))
    assert got == {"rows": 2, "missing_team_name": 0, "missing_price": 1, "unmapped_team_name": 1}


def test_filter_by(rows):
    df = rows("a int, b string", (1, "x"), (2, None), (3, "x"))
    assert filter_by(df, a=None).count() == 3
    assert collected(filter_by(df, a=(">", 1), b=["x", "y"]), "a") == [(3,)]
    assert collected(filter_by(df, b=("is null", True)), "a") == [(2,)]
    assert filter_by(df.withColumn("c", F.lit(1)), c=1, a=2).count() == 1


def test_lines_with_an_empty_first_field_and_quoted_breaks(spark, tmp_path):
    cases = {",Bob,X,7": ["", "Bob", "X", "7"], "a,,b,": ["a", "", "b", ""], ",,": ["", "", ""], '"a,b",c': ["a,b", "c"], '"","say ""x""",5" y,"open': ["", 'say "x"', '5" y', '"open'], "": [""], "a": ["a"]}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r[0]: r[1] for r in rows.select("line", period_files.fields(F.col("line"))).collect()} == cases
    folder = tmp_path / "data" / "2020-21"
    folder.mkdir(parents=True)
    (folder / "gw1.csv").write_bytes('\ufeff,name,team,minutes\r\n,Bob,X,7\r\n1,"Eve\nLong",Y,8\r\n\r\n,Kim,"Z, W",9'.encode())
    (folder / "gw2.csv").write_text("name,team,minutes\n" + f'"{"x" * 50000}",A,1\n' + "".join(f"P{k},B,{k}\n" for k in range(3000)))
    got = collected(period_files.read_period_files(spark, str(tmp_path / "data")), "gameweek", "player_name", "team_name", "minutes")
    assert sorted(r for r in got if r[0] == 1) == [(1, "Bob", "X", 7), (1, "Eve\nLong", "Y", 8), (1, "Kim", "Z, W", 9)]
    assert sorted(r for r in got if r[0] == 2) == sorted([(2, "x" * 50000, "A", 1), *((2, f"P{k}", "B", k) for k in range(3000))])
