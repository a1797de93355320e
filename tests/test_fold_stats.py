"""Sums, medians and ridge of all folds against fits of each fold alone; ranks with splitters from the data."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from result_rows import collected

from pastward.operators import fold_stats, gram, joins, ranks


def seasons(count, seed=4):
    draw = random.Random(seed)
    out = []
    for k in range(count):
        a = None if draw.random() < 0.2 else round(draw.gauss(3, 2), 2)
        b = None if draw.random() < 0.1 else float(draw.randrange(4))
        out.append((draw.randrange(1, 7), a, b, 2 * (a or 1) - (b or 0) + draw.gauss(0, 1)))
    return out


@pytest.mark.parametrize("min_train", [1, 2, 4])
def test_running_sums_and_medians(rows, min_train):
    data = seasons(400)
    df = rows("rank int, a double, b double, y double", *data).repartition(5)
    sums = {r["fold"]: (r["n"], r["s"]) for r in fold_stats.running_sums(df, "rank", {"n": F.count("*"), "s": F.sum("y")}, min_train).collect()}
    medians = {r["fold"]: r for r in fold_stats.medians(df, "rank", ["a", "b"], min_train).collect()}
    assert set(sums) == set(medians) == set(range(1, 6 - min_train + 1))
    for fold in sums:
        train = [r for r in data if r[0] <= fold + min_train - 1]
        assert sums[fold][0] == len(train) and abs(sums[fold][1] - sum(r[3] for r in train)) < 1e-9
        for i, c in ((1, "a"), (2, "b")):
            assert medians[fold][f"median_{c}"] == pytest.approx(statistics.median(r[i] for r in train if r[i] is not None), abs=1e-12)


def test_histograms_of_parts_merge(rows):
    data = [(r[0], r[1]) for r in seasons(300)]
    whole = fold_stats.season_histogram(rows("rank int, a double", *data), "rank", ["a"])
    parts = [fold_stats.season_histogram(rows("rank int, a double", *data[k::3]), "rank", ["a"]) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])  # equal values of a season in several rows
    assert collected(fold_stats.histogram_medians(merged)) == collected(fold_stats.histogram_medians(whole))


def test_medians_of_unknown_and_empty(rows):
    df = rows("rank int, a double", (1, None), (2, None), (3, 5.0), (4, 7.0), (5, 1.0))
    assert collected(fold_stats.medians(df, "rank", ["a"])) == [(2, 5.0), (3, 6.0)]
    assert fold_stats.medians(df.limit(0), "rank", ["a"]).collect() == []


@pytest.mark.parametrize("alpha", [0.5, 10.0])
def test_ridge_of_every_fold(rows, alpha):
    data = seasons(300)
    df = rows("rank int, a double, b double, y double", *data, (2, 1.0, 1.0, None))
    models = {r["fold"]: r for r in gram.walk_forward_ridge(df, "rank", ["a", "b"], "y", 2, alpha).collect()}
    assert set(models) == {1, 2, 3, 4}
    for fold, model in models.items():
        train = [r for r in data if r[0] <= fold + 1]
        middle = [statistics.median(r[i] for r in train if r[i] is not None) for i in (1, 2)]
        x = np.array([[r[i] if r[i] is not None else middle[i - 1] for i in (1, 2)] for r in train])
        y = np.array([r[3] for r in train])
        centred = x - x.mean(0)
        slope = np.linalg.solve(centred.T @ centred + alpha * np.eye(2), centred.T @ (y - y.mean()))
        assert np.allclose([model["a"], model["b"]], slope, atol=1e-9)
        assert model["intercept"] == pytest.approx(y.mean() - x.mean(0) @ slope, abs=1e-9) and model["residual"] < 1e-9
    out = gram.predict(df.withColumn("fold", F.col("rank") - 2), gram.walk_forward_ridge(df, "rank", ["a", "b"], "y", 2, alpha), ["a", "b"])
    row = next(r for r in out.collect() if r["a"] is None)
    m = models[row["fold"]]
    assert row["prediction"] == pytest.approx(m["intercept"] + m["a"] * m["median_a"] + m["b"] * (row["b"] if row["b"] is not None else m["median_b"]))


def test_feature_no_row_knows(rows):
    df = rows("rank int, a double, b double, y double", *[(k % 4 + 1, None, float(k), 2.0 * k) for k in range(40)])
    model = gram.walk_forward_ridge(df, "rank", ["a", "b"], "y", 2, 1e-6).orderBy("fold").head()
    assert model["a"] == 0.0 and model["b"] == pytest.approx(2.0, abs=1e-6)


def test_splitters_follow_the_values(spark):
    """A hundred thousand values that a bucket of fixed width would not tell apart."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), (F.lit(0.5) + F.col("id") * 1e-9).alias("v"))
    sizes = [r["count"] for r in ranks.bucketed(df, ["g"], "v").groupBy("_b").count().collect()]
    assert len(sizes) == ranks.BUCKETS and max(sizes) < 4 * 100_000 / ranks.BUCKETS
    assert ranks.median(df, ["g"], "v").head()["median"] == pytest.approx(0.5 + 49_999.5e-9, abs=1e-12)
    placed = ranks.value_ranks(df, [], "v").filter("first_rank = 77777").head()
    assert placed["v"] == pytest.approx(0.5 + 77_776e-9, abs=1e-13)


def test_splitters_with_ties_and_null_scopes(rows):
    df = rows("g string, v double", *[(g, float(v)) for g in ("a", None) for v in [1, 1, 1, 2, 3, 3]], ("b", None))
    got = {(r["g"], r["v"]): (r["first_rank"], r["last_rank"]) for r in ranks.value_ranks(df, ["g"], "v").collect()}
    assert got == {(g, v): n for g in ("a", None) for v, n in ((1.0, (1, 3)), (2.0, (4, 4)), (3.0, (5, 6)))}


def test_single_keys(rows):
    df = rows("k int, v int", (1, 1), (2, 2), (2, 3), (None, 4))
    assert collected(joins.single(df, ["k"]), "v") == [(1,), (4,)]
