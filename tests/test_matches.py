"""Ratings, tables and pair history on hand-made matches."""

import datetime as dt
import random

import pytest
from result_rows import collected

from pastward.operators import pairs, ratings, standings
from pastward.operators.match_features import upcoming_features
from pastward.operators.reshape import team_rows

SCHEMA = "match_id long, league int, season int, match_date date, event_time timestamp, home_team int, away_team int, home_goals int, away_goals int"


def season_rows(seed, seasons=3, teams=6, skip=()):
    rng = random.Random(seed)
    out, number = [], 0
    for league in (0, 1):
        for season in range(seasons):
            present = [t for t in range(teams) if (season, t) not in skip]
            for _ in range(40):
                home, away = rng.sample(present, 2)
                day = dt.date(2020 + season, 8, 1) + dt.timedelta(days=rng.randint(0, 30))
                number += 1
                out.append((number, league, season, day, dt.datetime.combine(day, dt.time(12 * rng.randint(0, 1))), home, away, rng.randint(0, 4), rng.randint(0, 4)))
    rng.shuffle(out)
    return out


def test_elo_with_returning_team(spark):
    data = season_rows(1, skip={(1, 3)})
    got = {r.match_id: r for r in ratings.elo(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(got) == len(data)
    for league in (0, 1):
        state, previous = {}, set()
        for season in range(3):
            mine = sorted((r for r in data if r[1] == league and r[2] == season), key=lambda r: (r[4], r[0]))
            present = {r[5] for r in mine} | {r[6] for r in mine}
            for t in present:
                if season == 0:
                    state[t] = 1500.0
                elif t not in previous:
                    state[t] = 1400.0
            for r in mine:
                h, a = state[r[5]], state[r[6]]
                e = 1 / (1 + 10 ** ((a - h - 50) / 400))
                s = 1.0 if r[7] > r[8] else 0.5 if r[7] == r[8] else 0.0
                assert got[r[0]].home_elo_before == pytest.approx(h) and got[r[0]].away_elo_before == pytest.approx(a)
                state[r[5]], state[r[6]] = h + 20 * (s - e), a - 20 * (s - e)
                assert got[r[0]].home_elo_after == pytest.approx(state[r[5]])
            previous = present


def test_elo_state_does_not_leak_between_leagues_of_one_task(spark):
    data = season_rows(2)
    one_task = spark.createDataFrame(data, SCHEMA).coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        first = [r for r in ratings.elo(one_task).collect() if r.season == 0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for league in (0, 1):
        opening = min((r for r in first if r.league == league), key=lambda r: (r.event_time, r.match_id))
        assert (opening.home_elo_before, opening.away_elo_before) == (1500.0, 1500.0)


def sides(spark, data):
    return team_rows(spark.createDataFrame(data, SCHEMA), ["match_id", "league", "season", "match_date", "event_time"], {
        "team": ("home_team", "away_team"), "opponent": ("away_team", "home_team"), "goals_for": ("home_goals", "away_goals"), "goals_against": ("away_goals", "home_goals"),
    })


def test_standings_leave_out_the_same_date(spark):
    data = season_rows(3, seasons=1)
    got = {(r.match_id, r.team): r for r in standings.standings_before(sides(spark, data), ["league", "season"]).collect()}
    for r in data:
        table = {}
        for m in data:
            if m[1] == r[1]:
                for t in (m[5], m[6]):
                    table.setdefault(t, [0, 0, 0, 0])
                if m[3] < r[3]:
                    for t, f, a in ((m[5], m[7], m[8]), (m[6], m[8], m[7])):
                        table[t][0] += 3 if f > a else 1 if f == a else 0
                        table[t][1] += f - a
                        table[t][2] += f
                        table[t][3] += 1
        order = sorted(table, key=lambda t: (-table[t][0], -table[t][1], -table[t][2], t))
        row = got[(r[0], r[5])]
        assert (row.points_before, row.goal_diff_before, row.games_played_before) == (table[r[5]][0], table[r[5]][1], table[r[5]][3])
        assert row.rank_before == order.index(r[5]) + 1
        assert row.points_to_1st_before == table[order[0]][0] - table[r[5]][0]
        assert row.points_above_18th_before is None


def test_pair_history_is_told_from_the_home_side(rows):
    day = dt.date(2024, 1, 1)

    def match(i, d, h, a, hg, ag):
        when = day + dt.timedelta(days=d)
        return (i, 0, 0, when, dt.datetime.combine(when, dt.time()), h, a, hg, ag)

    df = rows(SCHEMA, match(1, 0, 5, 7, 3, 1), match(2, 10, 7, 5, 2, 2), match(3, 10, 5, 7, 0, 4), match(4, 20, 7, 5, 0, 0))
    got = {r.match_id: r for r in pairs.pair_history(df, ["league"]).collect()}
    assert got[1].h2h_matches_prior == 0 and got[1].h2h_home_goals_avg_prior is None and got[1].h2h_last_meeting_result is None
    assert got[2].h2h_matches_prior == got[3].h2h_matches_prior == 1  # equal times do not see one another
    assert (got[2].h2h_home_goals_avg_prior, got[3].h2h_home_goals_avg_prior) == (1.0, 3.0)
    last = got[4]
    assert (last.h2h_matches_prior, last.h2h_home_wins_prior, last.h2h_draws_prior, last.h2h_away_wins_prior) == (3, 1, 1, 1)
    # The later id of the tied meetings counts as the last one: 5 lost 0-4 to 7.
    assert (last.h2h_last_meeting_days, last.h2h_last_meeting_home_goals, last.h2h_last_meeting_away_goals, last.h2h_last_meeting_result) == (10, 4, 0, "H")


def test_upcoming_fixture_with_newcomer(rows):
    fixtures = rows("fixture_id int, league int, home_team int, away_team int", (1, 0, 1, 9))
    state = rows("league int, team int, points_overall_last5 double, home_xg_home_last5 double, away_xg_away_last5 double", (0, 1, 2.0, 1.5, None))
    current = rows("league int, team int, rating double", (0, 1, 1550.0))
    row = upcoming_features(fixtures, state, current, ["league"]).first()
    assert (row.home_points_overall_last5, row.away_points_overall_last5, row.away_xg_away_last5) == (2.0, 0.0, 0.0)
    assert (row.home_elo_before, row.away_elo_before, row.elo_diff_home_adjusted) == (1550.0, 1400.0, 200.0)
    assert row.expected_home_score + row.expected_away_score == pytest.approx(1.0)


def test_team_rows_swap_sides(spark):
    data = season_rows(4, seasons=1)[:1]
    got = collected(sides(spark, data), "venue", "team", "goals_for")
    assert got == sorted([("H", data[0][5], data[0][7]), ("A", data[0][6], data[0][8])], key=repr)


def test_overlapping_tenures(spark):
    rng = random.Random(7)
    data = []
    for i in range(80):
        start = dt.date(2015, 1, 1) + dt.timedelta(days=rng.randint(0, 3000))
        end = None if rng.random() < 0.1 else start + dt.timedelta(days=rng.randint(-5, 60))
        data.append((i, rng.choice("xxy"), start, end))
    data = list({(r[1], r[2]): r for r in data}.values())  # one start per day, so the order is total
    df = spark.createDataFrame(data, "i int, e string, s date, t date")
    from pastward.operators.joins import overlaps

    expected = []
    for i, e, s, t in data:
        ends = [r[3] or dt.date(9999, 12, 31) for r in data if r[1] == e and r[2] < s]
        expected.append((i, bool(ends) and s <= max(ends), t is not None and s > t))
    assert collected(overlaps(df, ["e"], "s", "t"), "i", "overlaps", "invalid_range") == sorted(expected, key=repr)
