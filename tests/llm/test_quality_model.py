import random
import zlib

import numpy as np

from pastward.llm import quality_model as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(count, seed=1):
    """Bad texts repeat words, carry signs, or pair two words that are harmless alone."""
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        words = ["".join(draw.choice("aeioutnrsl") for _ in range(draw.randrange(2, 9))) for _ in range(draw.randrange(20, 60))]
        kind = draw.choice([None, None, None, "repeat", "signs"])
        if kind == "repeat":
            words = [w for w in words[:8] for _ in range(5)]
        if kind == "signs":
            words = [w + draw.choice(["###", "&&&"]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind is None), 0))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark, docs):
    rows, labels = corpus(500)
    model = Q.fit(docs(*rows), spark.createDataFrame(labels, LABELS))
    out = Q.scored(docs(*rows), model).select("doc_id", "score", Q.held_out().alias("held_out")).collect()
    truth = {k: q for k, q, _ in labels}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum((r["score"] >= Q.THRESHOLD) == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    assert Q.fit(docs(*rows).repartition(3), spark.createDataFrame(flipped, LABELS)) == model


def test_margin_equals_the_sum_over_pairs():
    draw = np.random.Generator(np.random.PCG64(2))
    weights, factors = draw.normal(size=Q.BUCKETS).astype(np.float32), draw.normal(size=(Q.BUCKETS, Q.RANK)).astype(np.float32)
    buckets, values = Q.Features()("Some words, some MORE words ### 12", 33)
    x, v = values.astype(float), factors[buckets].astype(float)
    pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i + 1, len(x)))
    expected = 0.7 + float(weights[buckets].astype(float) @ x) + pairs
    assert abs(Q.margin(weights, factors, 0.7, buckets, values) - expected) < 1e-4


def test_machine_learns_a_pair(monkeypatch):
    """Label 1 only where one of two words stands alone: no linear model separates that."""
    monkeypatch.setattr(Q, "EPOCHS", 400)
    rows = [([500, 501], 0), ([500], 1), ([501], 1), ([502], 0)] * 16
    model = Q._machine(np.array([r[1] for r in rows], float), [np.array(r[0], np.int32) for r in rows], [np.ones(len(r[0]), np.float32) for r in rows])
    weights, factors = model.arrays()
    for found, label in rows[:4]:
        assert (Q.margin(weights, factors, model.bias, np.array(found), np.ones(len(found), np.float32)) > 0) == bool(label)


def test_features():
    features = Q.Features()
    buckets, values = features("b a b", 5)
    words = buckets >= Q.RESERVED
    assert sum(words) == 2 and abs(float((values[words] ** 2).sum()) - 1) < 1e-6 and sum(~words) == len(Q.STATISTICS)
    assert features("B A b", 5)[0][words].tolist() == buckets[words].tolist()
    assert len(features(None)[0]) == len(Q.STATISTICS)
    assert features("x", 1)[0].tolist() != features("x", 2)[0].tolist()


def test_special_rows(spark, docs, clashing):
    rows, labels = corpus(200)
    label = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (7, 0, 0), (10_000, 1, 1)], LABELS)
    model = Q.fit(docs(*rows, (3, None), (4, "twice")), label)
    df = clashing(docs((None, None), (1, ""), (2, "word " * 30_000), (2, "word " * 30_000)))
    out = Q.scored(df, model)
    assert set(out.columns) == set(df.columns)
    scores = [r["score"] for r in out.orderBy("doc_id").collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[2] == scores[3]
    assert len(Q.scored(df.drop("n_chars"), model).collect()) == 4
    assert len(Q.scored(df.withColumn("n_chars", Q.F.lit("odd")), model).collect()) == 4
    assert Q.scored(docs(), model).collect() == []
    assert Q.scored(docs((1, "x")), Q.fit(docs(), label.limit(0))).head()["score"] == 0.5
    ones = Q.fit(docs(*rows), label.filter("quality = 1"))
    assert Q.scored(docs((1, "x")), ones).head()["score"] > 0.9
