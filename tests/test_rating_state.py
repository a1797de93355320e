"""Ratings that go on from a stored state, against one run over everything."""

import random

import pytest
from result_rows import collected

from pastward.operators import ratings
from pastward.sources import versions

SCHEMA = "match_id long, league string, season int, match_date int, event_time int, home_team string, away_team string, home_goals int, away_goals int"
RATED = ("match_id", "home_elo_before", "away_elo_before", "home_elo_after", "home_initialization", "away_initialization")


def played(seed=11):
    """Two leagues; teams drop out for a season, one for two, and league y begins two seasons later."""
    draw, out, number = random.Random(seed), [], 0
    for season in range(6):
        for league in "xy" if season >= 2 else "x":
            teams = [t for k, t in enumerate("abcdef") if (season + k) % 5 != 0 and not (t == "f" and season in (2, 3))]
            for day in range(12):
                home, away = draw.sample(teams, 2)
                out.append((number, league, season, 100 * season + day // 2, 100 * season + day // 2, home, away, draw.randrange(4), draw.randrange(4)))
                number += 1
    return out


@pytest.mark.parametrize("cuts", [(2,), (1, 2, 4), (3,)])
def test_appended_seasons_equal_one_run(rows, tmp_path, cuts):
    data, path = played(), str(tmp_path / "state")
    whole = ratings.elo(rows(SCHEMA, *data))
    expected = {r[0]: r for r in collected(whole, *RATED)}
    bounds = [0, *cuts, 6]
    for low, high in zip(bounds, bounds[1:]):
        new = rows(SCHEMA, *[r for r in data if low <= r[2] < high])
        for row in collected(ratings.replay_seasons(new, path), *RATED):
            assert row == expected[row[0]]
    stored = ratings.load_state(new.sparkSession, path)
    direct = ratings.season_end_state(whole)
    assert stored.columns == direct.columns and collected(stored) == collected(direct)
    current = collected(ratings.current_ratings(whole, ["league"]), "league", "team", "rating")
    assert collected(stored, "league", "team", "rating") == current
    assert versions.committed(new.sparkSession, path) == list(range(len(bounds) - 1))


def test_seasons_that_are_in_the_state_are_refused(rows, tmp_path):
    data, path = played(), str(tmp_path / "state")
    ratings.replay_seasons(rows(SCHEMA, *[r for r in data if r[2] < 3]), path)
    with pytest.raises(Exception, match="does not begin after"):
        ratings.replay_seasons(rows(SCHEMA, *[r for r in data if r[2] >= 2]), path)
    assert versions.committed(ratings.load_state(rows(SCHEMA).sparkSession, path).sparkSession, path) == [0]


def test_state_that_was_not_committed_is_not_read(rows, tmp_path, monkeypatch):
    data, path = played(), str(tmp_path / "state")
    first = rows(SCHEMA, *[r for r in data if r[2] < 3])
    ratings.replay_seasons(first, path)
    before = collected(ratings.load_state(first.sparkSession, path))
    later = rows(SCHEMA, *[r for r in data if r[2] >= 3])
    with monkeypatch.context() as patched:
        patched.setattr(versions, "mark", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            ratings.replay_seasons(later, path)
    assert collected(ratings.load_state(first.sparkSession, path)) == before
    ratings.replay_seasons(later, path)
    assert collected(ratings.load_state(first.sparkSession, path)) == collected(ratings.season_end_state(ratings.elo(rows(SCHEMA, *data))))


def test_no_new_matches_leave_the_state_as_it_is(rows, tmp_path):
    path = str(tmp_path / "state")
    ratings.replay_seasons(rows(SCHEMA, *[r for r in played() if r[2] < 2]), path)
    before = collected(ratings.load_state(rows(SCHEMA).sparkSession, path))
    assert ratings.replay_seasons(rows(SCHEMA), path).count() == 0
    assert collected(ratings.load_state(rows(SCHEMA).sparkSession, path)) == before
