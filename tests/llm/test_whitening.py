import math
import random

import numpy as np

from pastward.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x") for k, v in rows], SCHEMA)


def drawn(count, dims, seed=3):
    draw = random.Random(seed)
    return [(k, [draw.gauss(0, 0.1 * (1 + i)) for i in range(dims)]) for k in range(count)]


def brute(rows):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(x, float) - np.array(sums) / n
    variances, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-variances)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    return n, centred, variances[order], axes.T[order], deviation


def test_equals_the_covariance_of_products(spark):
    rows = drawn(300, 7)
    df = vectors(spark, rows).repartition(5)
    model = W.fit(df)
    n, centred, variances, axes, deviation = brute(rows)
    assert model.n == n and np.allclose(model.variances, variances, rtol=1e-12) and np.isclose(model.trace, variances.sum(), rtol=1e-13)
    assert np.allclose(np.abs((np.array(model.axes) * axes).sum(1)), 1, atol=1e-9)
    out = {r["vec_id"]: r for r in W.whitened(df, model).collect()}
    for k, _ in rows:
        expected = axes @ centred[k] / np.sqrt(variances)
        sign = np.sign((np.array(model.axes) * axes).sum(1))
        assert out[k]["deviation"] == deviation[k] and np.allclose(out[k]["whitened"], expected * sign, atol=1e-8)
    assert W.identity_error(W.whitened(df, model), model) < 1e-9


def test_only_so_many_components(spark):
    df = vectors(spark, drawn(50, 6))
    model = W.fit(df, components=2)
    assert len(model.variances) == 2 and all(len(r["whitened"]) == 2 for r in W.whitened(df, model).collect())


def test_unusable_vectors_are_dropped(spark, clashing):
    rows = drawn(40, 3)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    df = clashing(vectors(spark, [*rows, *odd, (None, rows[0][1]), rows[1]])).withColumn("whitened", W.F.lit("x")).withColumn("i", W.F.lit("y"))
    model = W.fit(df)
    assert model.n == 42 and model.dims == 3
    out = W.whitened(df, model)
    assert set(out.columns) == {*df.columns, "deviation"} and out.count() == 42
    same = [r["whitened"] for r in out.collect() if r["vec_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]


def test_no_variance_and_empty(spark):
    empty = vectors(spark, [])
    assert W.fit(empty) is None and W.whitened(empty, None).collect() == [] and W.identity_error(W.whitened(empty, None), None) is None
    one = vectors(spark, [(1, [0.5, 0.25])])
    model = W.fit(one)
    row = W.whitened(one, model).head()
    assert row["whitened"] == [None, None] and row["deviation"] == 0 and W.identity_error(W.whitened(one, model), model) == 0.0
    flat = vectors(spark, [(k, [float(k), 7.0]) for k in range(5)])
    model = W.fit(flat)
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in W.whitened(flat, model).collect())


def test_large_values_stay_exact(spark):
    rows = [(k, [float(2**40 + 2**20 * k), float(-(2**41) + 3 * 2**20 * k)]) for k in range(6)]
    df = vectors(spark, rows)
    model = W.fit(df)
    _, _, variances, _, deviation = brute(rows)
    assert np.isclose(model.variances[0], variances[0], rtol=1e-9)
    assert [r["deviation"] for r in W.whitened(df, model).orderBy("vec_id").collect()] == [d if d < 1 << 63 else None for d in deviation]
