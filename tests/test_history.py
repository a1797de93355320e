"""Window and rank operators against brute force, with ties and one entity that holds most rows."""

import random

import pytest
from result_rows import collected
from pyspark.sql import functions as F

from pastward.operators import history, ranks


def events(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        entity = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((entity, rng.randint(1, 25), i, rng.choice([None, 1.0, 2.0, 3.5])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prior_strict(spark, seed):
    data = events(seed)
    df = spark.createDataFrame(data, "e string, t int, id int, v double")
    got = history.prior_strict(df, ["e"], "t", ["id"], ["v"], 5).select(
        "e", "t", history.history_count(5).alias("n5"), history.history_count(3).alias("n3"),
        history.history_mean("v", 5).alias("m5"), history.history_mean("v", 3, min_rows=3).alias("m3"),
    )
    expected = []
    for e, t in {(r[0], r[1]) for r in data}:
        past = sorted([(r[1], r[2], r[3]) for r in data if r[0] == e and r[1] < t])
        last5, last3 = [r[2] for r in past[-5:]], [r[2] for r in past[-3:]]
        known5, known3 = [v for v in last5 if v is not None], [v for v in last3 if v is not None]
        m5 = sum(known5) / len(known5) if known5 else None
        m3 = sum(known3) / len(known3) if known3 and len(last3) == 3 else None
        expected.append((e, t, len(last5), len(last3), m5, m3))
    assert collected(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("n", [1, 5])
def test_prior_rows_sees_ties_in_order(spark, seed, n):
    data = events(seed)
    df = spark.createDataFrame(data, "e string, t int, id int, v double")
    got = history.prior_rows(df, ["e"], "t", ["id"], n, {"c": F.count("*"), "s": F.sum("v")})
    expected = []
    for e, t, i, v in data:
        past = sorted((r[1], r[2], r[3]) for r in data if r[0] == e and (r[1], r[2]) < (t, i))[-n:]
        known = [x[2] for x in past if x[2] is not None]
        expected.append((e, t, i, v, len(past), sum(known) if known else None))
    assert collected(got, "e", "t", "id", "v", "c", "s") == sorted(expected, key=repr)


def with_kinds(seed):
    rng = random.Random(seed)
    return [(*r, rng.choice(["H", "H", "H", "A", None] if r[0] == "a" else ["H", "A"])) for r in events(seed)]


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_both_frames_of_earlier_blocks(spark, seed):
    data = with_kinds(seed)
    df = spark.createDataFrame(data, "e string, t int, id int, v double, kind string")
    got = history.carried_by_kind(df, ["e"], "t", "kind", ["id"], ["v"], 6, 3).select(
        "e", "t", "kind", F.col("history.id").alias("ids"), F.col("kind_history.id").alias("own"))
    expected = []
    for e, t, kind in {(r[0], r[1], r[4]) for r in data}:
        past = sorted((r[1], r[2], r[4]) for r in data if r[0] == e and r[1] < t)[::-1]
        expected.append((e, t, kind, [r[1] for r in past[:6]], [r[1] for r in past if r[2] == kind][:3]))
    assert collected(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", [9, 10])
@pytest.mark.parametrize("n", [1, 5])
def test_both_frames_of_rows_see_ties_in_order(spark, seed, n):
    data = with_kinds(seed)
    df = spark.createDataFrame(data, "e string, t int, id int, v double, kind string")
    got = history.prior_rows_by_kind(
        df, ["e"], "t", "kind", ["id"], n, {"c": F.count("*"), "s": F.sum("v")}, {"kc": F.count("*"), "ks": F.sum("v")})
    expected = []
    for e, t, i, v, kind in data:
        past = sorted((r[1], r[2], r[3], r[4]) for r in data if r[0] == e and (r[1], r[2]) < (t, i))
        found = []
        for frame in (past[-n:], [r for r in past if r[3] == kind][-n:]):
            known = [r[2] for r in frame if r[2] is not None]
            found += [len(frame), sum(known) if known else None]
        expected.append((e, t, i, v, kind, *found))
    assert collected(got, "e", "t", "id", "v", "kind", "c", "s", "kc", "ks") == sorted(expected, key=repr)


def test_latest_by_takes_null_order_as_smallest(rows):
    df = rows("k int, o int, v string", (1, None, "a"), (1, 3, "b"), (2, None, "c"))
    assert collected(history.latest_by(df, ["k"], ["o"]), "k", "v") == [(1, "b"), (2, "c")]


def test_empty_input(spark):
    df = spark.createDataFrame([], "e string, t int, id int, v double")
    assert history.prior_strict(df, ["e"], "t", ["id"], ["v"], 5).count() == 0
    assert history.prior_rows(df, ["e"], "t", ["id"], 5, {"c": F.count("*")}).count() == 0


@pytest.mark.parametrize("seed", [6, 7])
def test_positions_and_running_totals(spark, seed):
    data = events(seed)
    df = spark.createDataFrame(data, "e string, t int, id int, v double")
    got = collected(ranks.positions(df, ["e"], "t", ["id"]), "e", "id", "position", "scope_rows")
    expected = []
    for e, t, i, _ in data:
        mine = sorted((r[1], r[2]) for r in data if r[0] == e)
        expected.append((e, i, mine.index((t, i)), len(mine)))
    assert got == sorted(expected, key=repr)
    totals = collected(ranks.running_totals(df, ["e"], "t", ["id"], F.lit(1), "n"), "e", "id", "n")
    assert totals == sorted(((e, i, p + 1) for e, i, p, _ in expected), key=repr)


@pytest.mark.parametrize("seed", [8, 9])
def test_median_and_ranks(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), rng.choice([None, *[x / 4 for x in range(20)]])) for _ in range(101)]
    df = spark.createDataFrame(data, "g string, v double")
    medians = dict(collected(ranks.median(df, ["g"], "v", F.floor("v"))))
    for g in "ab":
        values = sorted(v for h, v in data if h == g and v is not None)
        n = len(values)
        assert medians[g] == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_spearman(rows):
    df = rows("x double, y double", (1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (3.0, 4.0), (None, 1.0))
    got = ranks.spearman(df, "x", "y", F.floor("x"), F.floor("y")).first()[0]
    # Mean ranks 1, 2, 3.5, 3.5 and 1.5, 1.5, 4, 3 of the complete pairs.
    a, b = [1, 2, 3.5, 3.5], [1.5, 1.5, 4, 3]
    ab = sum((p - 2.5) * (q - 2.5) for p, q in zip(a, b))
    aa, bb = sum((p - 2.5) ** 2 for p in a), sum((q - 2.5) ** 2 for q in b)
    assert got == pytest.approx(ab / (aa * bb) ** 0.5)
    flat = rows("x double, y double", (1.0, 2.0), (1.0, 3.0))
    assert ranks.spearman(flat, "x", "y", F.floor("x"), F.floor("y")).first()[0] == 0.0
