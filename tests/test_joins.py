"""Guards of joins and lookups."""

import pytest
from result_rows import collected

from pastward.operators import joins, quality


def test_many_to_one_and_one_to_one(rows):
    left, right = rows("k int, a int", (1, 1), (1, 2), (2, 3)), rows("k int, b int", (1, 10), (3, 30))
    assert collected(joins.many_to_one(left, right, ["k"]), "k", "a", "b") == sorted([(1, 1, 10), (1, 2, 10), (2, 3, None)], key=repr)
    with pytest.raises(Exception, match="not unique: k=1"):
        joins.many_to_one(right, left, ["k"]).collect()
    with pytest.raises(Exception, match="without a match"):
        joins.one_to_one(left.filter("a > 1"), right, ["k"]).collect()
    with pytest.raises(Exception, match="not unique"):
        joins.one_to_one(left.filter("k = 1"), right.filter("k = 1"), ["k"]).collect()
    assert joins.one_to_one(left.filter("a = 1"), right.filter("k = 1"), ["k"]).count() == 1


def test_guarded_inner(rows):
    left, right = rows("k int", (1,), (2,)), rows("k int, b int", (1, 10), (2, 20))
    assert joins.guarded_inner(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="without a match: k=2"):
        joins.guarded_inner(left, right.filter("k = 1"), ["k"]).collect()
    assert joins.guarded_inner(left, right.filter("k = 1"), ["k"], complete=False).count() == 1
    with pytest.raises(Exception, match="not unique"):  # one lost and one doubled row don't make up for each other
        joins.guarded_inner(left, rows("k int, b int", (1, 1), (1, 2)), ["k"], complete=False).collect()


def test_guarded_inner_with_repeated_keys(rows):
    left, right = rows("k int, a int", (1, 1), (1, 2), (2, 3), (None, 4)), rows("k int, b int", (1, 10), (1, 20), (2, 30), (None, 40))
    found = joins.guarded_inner(left, right, ["k"], complete=False, unique=False)
    assert collected(found, "k", "a", "b") == [(1, 1, 10), (1, 1, 20), (1, 2, 10), (1, 2, 20), (2, 3, 30)]
    assert joins.guarded_inner(left.filter("k > 0"), right, ["k"], unique=False).count() == 5
    with pytest.raises(Exception, match="without a match"):
        joins.guarded_inner(left, right, ["k"], unique=False).collect()


def test_feed_meets_all_matches_of_a_repeated_key(rows):
    """Two matches of one day and pair are in the result with each feed row of theirs, not left out."""
    from types import SimpleNamespace

    from pastward.plans import relational

    schema = "match_id int, season int, league int, match_date string, home_team int, away_team int, home_goals int, away_goals int, home_xg double, away_xg double"
    data = [(k, 2000, 1, "d", home, 2, k, 0, 1.0, xg) for k, home, xg in ((1, 1, 0.5), (2, 1, 0.6), (3, 1, 0.0), (4, 5, 0.7), (5, 6, 0.0))]
    found = relational.matches_with_feed(SimpleNamespace(matches=rows(schema, *data)))
    assert collected(found, "match_id", "feed_id", "away_xg") == [(1, 1, 0.5), (1, 2, 0.6), (2, 1, 0.5), (2, 2, 0.6), (3, 1, 0.5), (3, 2, 0.6), (4, 4, 0.7)]



def test_strict_mapping_fails_on_unknown(rows):
    df = rows("team string", ("A",), (None,), ("C",))
    mapping = rows("source string, target string", ("A", "Alpha"))
    with pytest.raises(Exception, match="unknown team: C"):
        joins.map_strict(df, "team", mapping, "source", "target", "name").collect()
    known = joins.map_strict(df.filter("team IS NULL OR team = 'A'"), "team", mapping, "source", "target", "name")
    assert collected(known, "team", "name") == sorted([("A", "Alpha"), (None, None)], key=repr)
    with pytest.raises(Exception, match="unknown team: C"):
        joins.map_values(df, "team", {"A": "Alpha"}, "name").collect()


def test_two_stage_match_prefers_the_id(rows):
    pred = rows("p int, id int, k string", (1, 10, "x"), (2, None, "x"), (3, 99, "y"), (4, None, "z"))
    res = rows("id int, k string, r string", (10, "q", "H"), (11, "x", "A"), (12, "x", "D"), (13, "y", "D"))
    got = collected(joins.two_stage(pred, res, "p", "id", ["k"], ["id"], ["r"]), "p", "r", "matched_by")
    assert got == [(1, "H", "id"), (2, "A", "natural_key"), (3, "D", "natural_key")]
    doubled = res.unionAll(res.filter("id = 10"))
    assert joins.two_stage(pred, doubled, "p", "id", ["k"], ["id"], ["r"]).count() == 3
    for strict, error in ((doubled.filter("k <> 'x'"), "repeated id"), (res, "repeated natural key")):
        with pytest.raises(Exception, match=error):
            joins.two_stage(pred, strict, "p", "id", ["k"], ["id"], ["r"], strict=True).collect()


def test_coverage_and_difference(rows):
    left, right = rows("k int, v int", (1, 1), (2, None), (3, 3)), rows("k int, v int", (2, 5), (3, 3), (4, 4))
    assert collected(quality.coverage(left, right, ["k"], ("l", "r"))) == [(2, 1, 1)]
    assert dict(collected(quality.difference(left, right, ["k"], ["v"]))) == {"only_left": 1, "only_right": 1, "differs_v": 1}
