"""Decisions, scores, slices, splits, ranking, scorelines and squads on small cases."""

import math
import random

import pytest
from result_rows import collected
from pyspark.sql import functions as F

from pastward.operators import aggregates, decisions, metrics, models, quality, ranking, scorelines, selection, slicing, splits


@pytest.mark.parametrize("p, argmax, second", [
    ((0.4, 0.4, 0.2), "H", True), ((0.2, 0.4, 0.4), "D", False), ((0.4, 0.2, 0.4), "H", False), ((0.3, 0.3, 0.4), "A", False),
    ((0.25, 0.35, 0.4), "A", True), ((0.5, 0.3, 0.2), "H", True),
])
def test_ties_follow_label_order(rows, p, argmax, second):
    row = rows("p_home double, p_draw double, p_away double", p).select(
        decisions.argmax_label().alias("a"), decisions.draw_is_second().alias("s"), decisions.overlay_label(0.25).alias("o")
    ).first()
    assert (row.a, row.s) == (argmax, second)
    assert row.o == ("D" if second and p[1] >= 0.25 and max(p) < 0.5 else argmax)


def test_individual_loss_is_bounded(rows):
    df = rows("actual string, p_home double, p_draw double, p_away double", ("H", 0.0, 0.5, 0.5), ("D", 1.0, 1.0, 0.0))
    got = [r[0] for r in metrics.with_scores(df, "actual").select("row_log_loss").collect()]
    assert got == pytest.approx([-math.log(1e-15), math.log(2)])


def test_undefined_scores_are_zero(rows):
    df = rows("actual string, predicted string", ("H", "H"), ("A", "H"))
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_table(df, "actual", "predicted").collect()}
    assert got["D"] == (0.0, 0.0, 0.0, 0) and got["H"] == pytest.approx((0.5, 1.0, 2 / 3, 1))
    cells = {r.actual: (r.pred_H, r.pred_D, r.pred_A) for r in metrics.confusion(df, "actual", "predicted").collect()}
    assert cells == {"H": (1, 0, 0), "D": (0, 0, 0), "A": (1, 0, 0)}


def test_bins_are_left_closed_and_empty_ones_stay(rows):
    df = rows("v double, w int", (0.2, 1), (0.3999, 2), (0.4, 3), (None, 4), (0.1, 5))
    got = collected(slicing.bin_table(df, "v", [0.2, 0.4, 0.6, 0.8], ["a", "b", "c"], {"s": F.sum("w")}), "bin", "count", "s")
    assert got == [("a", 2, 3), ("b", 1, 3), ("c", 0, None)]


def test_empty_segment_stays(rows):
    df = rows("f boolean, v int", (True, 1), (True, 3))
    assert collected(slicing.two_segments(df, F.col("f"), ("yes", "no"), {"m": F.avg("v")}), "segment", "count", "m") == sorted([("yes", 2, 2.0), ("no", 0, None)], key=repr)


def test_season_thirds(spark):
    for n in (1, 2, 4, 7, 9):
        df = spark.range(n).select(F.lit(1).alias("s"), (F.col("id") / 3).cast("int").alias("d"), "id")
        got = [r.season_stage for r in slicing.season_stage(df, ["s"], "d", ["id"]).orderBy("id").collect()]
        assert got == ["early" if i < n / 3 else "middle" if i < 2 * n / 3 else "late" for i in range(n)]


def test_period_split_keeps_seasons_in_order(rows):
    df = rows("season string, gameweek int, fixture_id int", ("2023-24", 38, 1), ("2024-25", 1, 2), ("2023-24", 37, 3), ("2024-25", 2, 4), ("2024-25", None, 5))
    got = dict(collected(splits.period_split(df, ["season", "gameweek"], 0.5), "fixture_id", "part"))
    assert got == {1: "train", 3: "train", 2: "test", 4: "test"}
    with pytest.raises(Exception, match="not enough periods"):
        splits.period_split(df.filter("gameweek = 38"), ["season", "gameweek"]).collect()


def test_walk_forward(rows):
    df = rows("season string, d date", *[(s, __import__("datetime").date(2020 + i, 1, 1)) for i, s in enumerate("pqrs")])
    got = collected(splits.walk_forward(df, "season", "d"), "fold", "role", "season")
    assert got == sorted([(1, "train", "p"), (1, "train", "q"), (1, "validation", "r"), (2, "train", "p"), (2, "train", "q"), (2, "train", "r"), (2, "validation", "s")], key=repr)
    triples = collected(splits.fit_calibrate_validate(df, "season", "d"), "fold", "role", "season")
    assert (2, "calibrate", "r") in triples and (2, "fit", "q") in triples and (1, "validate", "r") in triples
    assert splits.fold_windows(splits.walk_forward(df, "season", "d"), "d").filter("NOT no_leak").count() == 0


@pytest.mark.parametrize("n, k", [(12, 5), (13, 3), (20, 4)])
def test_time_series_folds(spark, n, k):
    df = spark.range(n).select((F.col("id") / 4).cast("int").alias("d"), "id")
    rows = splits.time_series_folds(df, "d", ["id"], k).collect()
    size = n // (k + 1)
    for fold in range(1, k + 1):
        start = n - (k + 1 - fold) * size
        assert sorted(r.id for r in rows if r.fold == fold and r.role == "train") == list(range(start))
        assert sorted(r.id for r in rows if r.fold == fold and r.role == "test") == list(range(start, start + size))


def test_holdout_guard(rows):
    df = rows("season int", (1,), (2,))
    assert splits.assert_absent(df, "season", rows("x int", (3,))).count() == 2
    with pytest.raises(Exception, match="must stay unseen"):
        splits.assert_absent(df, "season", rows("x int", (2,))).collect()


def test_majority_prefers_label_order(rows):
    row = splits.majority_baseline(rows("y string", ("A",), ("D",), ("A",), ("D",)), "y", ("H", "D", "A")).first()
    assert (row.majority, row.share_H, row.share_D) == ("D", 0.0, 0.5)


def brute_ndcg(rows, k):
    """Tie-averaged NDCG on (target, prediction) pairs."""
    low = min(t for t, _ in rows)
    gains = [(t - low, p) for t, p in rows]

    def dcg(key):
        total, place = 0.0, 0
        for value in sorted({g[key] for g in gains}, reverse=True):
            tied = [g[0] for g in gains if g[key] == value]
            discount = sum(1 / math.log2(i + 2) for i in range(place, place + len(tied)) if i < k)
            total += sum(tied) / len(tied) * discount
            place += len(tied)
        return total

    return dcg(1) / dcg(0) if dcg(0) > 0 else 1.0


@pytest.mark.parametrize("k", [1, 3, 10, 50])
def test_ndcg(spark, k):
    rng = random.Random(k)
    data = [(w, rng.randint(-2, 6), rng.choice([0.5, 1.0, 1.5, 2.25])) for w in range(4) for _ in range(25)] + [(9, 3, 1.0), (9, 3, 2.0)]
    got = dict(collected(ranking.ndcg(spark.createDataFrame(data, "w int, t int, p double"), ["w"], "t", "p", k)))
    for w in {d[0] for d in data}:
        assert got[w] == pytest.approx(brute_ndcg([(t, p) for v, t, p in data if v == w], k))


def test_choose_candidate(rows):
    scores = rows("model string, mae double, ndcg_at_25 double", ("base", 1.0, 0.5), ("a", 0.9, 0.4), ("b", 0.9, 0.6), ("c", 1.1, 0.9))
    assert ranking.choose_candidate(scores, "base").first().model == "b"
    assert ranking.choose_candidate(scores.filter("mae >= 1"), "base").count() == 0


def test_scoreline_probabilities(rows):
    inputs = {c: 1.0 for c in scorelines.INPUTS}
    df = rows("home_lambda double, away_lambda double", (1.4, 1.1), (0.05, 5.0))
    out = scorelines.with_outcomes(scorelines.with_pmf(df)).withColumn("top", scorelines.top_scorelines())
    assert quality.rule_violations(out, scorelines.sanity_rules()).filter("violations > 0").count() == 0
    row = out.orderBy(F.col("home_lambda").desc()).first()
    pmf = lambda m: [math.exp(-m) * m**g / math.factorial(g) for g in range(7)]
    h, a = pmf(1.4), pmf(1.1)
    assert row.p_draw == pytest.approx(sum(x * y for x, y in zip(h, a)) / sum(h) / sum(a))
    assert [(t.home_score, t.away_score) for t in row.top][:2] == [(1, 1), (1, 0)]
    train = rows("fold int, home_goals int, away_goals int, " + ", ".join(f"{c} double" for c in inputs), (1, 2, 1, *[None] * 8), (1, 0, 1, *[None] * 8))
    params = scorelines.fit_parameters(train, ["fold"]).first()
    assert (params.avg_home_xg, params.avg_xga, params.median_home_xg_home_last5, params.median_home_xga_home_last5) == (1.0, 1.0, 1.0, 1.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_undominated_matches_pairwise_rule(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 1, 1, 2]), rng.randint(1, 2), rng.randint(40, 46), rng.choice([1.0, 2.0, 2.5, 3.0, 4.0])) for i in range(150)]

    def better(q, p):
        return q[1:3] == p[1:3] and q[0] != p[0] and q[4] >= p[4] and q[3] <= p[3] and (q[4] > p[4] or q[3] < p[3] or q[0] < p[0])

    expected = [(p[0],) for p in data if sum(better(q, p) for q in data) < 3]
    df = spark.createDataFrame(data, "id int, team int, pos int, cost int, pts double")
    assert collected(selection.undominated(df, ["team", "pos"], "cost", "pts", "id"), "id") == sorted(expected, key=repr)


def test_modes_and_lists(rows):
    df = rows("k int, v string", (1, "b"), (1, "a"), (1, None), (2, None), (3, "z"), (3, "z"), (3, "a"))
    assert collected(aggregates.modes(df, ["k"], ["v"])) == sorted([(1, "a"), (2, None), (3, "z")], key=repr)
    top = aggregates.distinct_lists(df.filter("v IS NOT NULL"), ["k"], "v", 1).first()
    assert (top.k, top.distinct_count, top.rows, top.examples) == (3, 2, 3, "a, z")


def test_quality_findings(rows):
    df = rows("a int, b string, c double", (1, " ", None), (1, "x", 2.0), (None, None, 3.0))
    assert dict(collected(quality.rule_violations(df, {"positive": "a > 1", "c_small": "c < 3"}))) == {"positive": 2, "c_small": 1}
    nulls = {r.column_name: r.null_count for r in quality.null_profile(df, ["a", "b", "c"], ["b"]).collect()}
    assert nulls == {"a": 1, "b": 2, "c": 1}
    found = quality.check_features(df, ["a", "b", "x", "a"], forbidden=["a"], forbidden_tokens=["x"], expected=3)
    assert len(found) == 6
    good, bad = quality.quarantine(df, {"a known": F.col("a").isNotNull(), "c known": F.col("c").isNotNull()})
    assert good.count() == 1 and collected(bad, "validation_error") == [("a known",), ("c known",)]
    with pytest.raises(ValueError, match="checks failed"):
        quality.require(quality.rule_violations(df, {"positive": "a > 1"}))


def test_logistic_learns_a_clear_rule(spark):
    rng = random.Random(5)
    data = [("HDA"[c], c + rng.random() * 0.2, None if rng.random() < 0.1 else rng.random()) for c in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(data, "y string, x double, noise double")
    scored = models.predict_classes(models.fit_logistic(df, ["x", "noise"], "y"), df)
    assert metrics.evaluate(scored, "y").first().accuracy > 0.95
    assert set(decisions.PROBS) <= set(scored.columns)
