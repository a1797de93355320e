import random
import zlib

from pastward.llm import toxicity as T

BAD = ["zorgle", "krumpf", "bliktar"]


def corpus(count, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        words = ["".join(draw.choice("aeioutnrsl") for _ in range(draw.randrange(2, 9))) for _ in range(draw.randrange(5, 60))]
        bad = draw.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark, docs):
    rows, labels = corpus(600)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(docs(*rows), label)
    out = T.scored(docs(*rows), model).select("doc_id", "score", T.held_out().alias("held_out")).collect()
    truth = {k: t for k, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum((r["score"] >= T.THRESHOLD) == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels]
    assert T.fit(docs(*rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")) == model


def test_grams_are_distinct_buckets():
    grams = T.Grams()
    once, twice = grams("abcdefgh xyz"), grams("abcdefgh xyz" * 2)
    assert len(set(once.tolist())) == len(once) and set(once.tolist()) <= set(twice.tolist())
    assert len(grams("ab")) == len(grams(None)) == 0 and grams("ABC").tolist() == grams("abc").tolist()


def test_an_id_that_repeats_is_learned_from_once(spark, docs):
    rows, labels = corpus(120)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(3, "zz later text")] * 500
    chosen, _ = T._training_rows(docs(*rows, *more), label, T.SAMPLE, T.POSITIVE)
    found = {r["doc_id"]: r["text"] for r in chosen.collect()}
    assert chosen.count() == len(found) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k, _ in rows)
    assert T.fit(docs(*rows, *more), label) == T.fit(docs(*rows), label)


def test_ratios_and_optimum_against_brute_force(spark, docs):
    import numpy as np

    rows, labels = corpus(150, seed=4)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(docs(*rows), label)
    truth, grams = {k: t for k, _, t in labels}, T.Grams()
    sets = [(truth[k], set(grams(text).tolist())) for k, text in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    ones = [found for t, found in sets if t]
    zeros = [found for t, found in sets if not t]
    ratio = {}
    for bucket in set().union(*ones, *zeros):
        p, q = sum(bucket in found for found in ones), sum(bucket in found for found in zeros)
        if p + q >= 4:
            r = np.log((p + T.SMOOTHING) / (len(ones) + T.SMOOTHING)) - np.log((q + T.SMOOTHING) / (len(zeros) + T.SMOOTHING))
            ratio[bucket] = (r, abs(r) * np.sqrt(p + q))
    best = sorted(ratio, key=lambda b: (-ratio[b][1], b))[: T.FEATURES]
    learned = np.frombuffer(model.weights, np.float32)
    assert set(np.flatnonzero(learned).tolist()) <= set(best)
    at = {b: i for i, b in enumerate(best)}
    values = np.zeros((len(sets), len(best)))
    for i, (_, found) in enumerate(sets):
        for b in found & at.keys():
            values[i, at[b]] = ratio[b][0]
    y = np.array([t for t, _ in sets], float)
    ratios = np.array([ratio[b][0] for b in best])
    weight = np.divide(learned[best].astype(float), ratios, out=np.zeros(len(best)), where=ratios != 0)
    share = y.mean()
    bias = model.intercept + np.log(len(ones) / len(zeros)) - np.log(share / (1 - share))

    def loss(w, b):
        z = values @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + T.RIDGE * (w @ w) / (2 * len(y))

    least = loss(weight, bias)
    draw = np.random.default_rng(1)
    assert all(loss(weight + step * d, bias) > least - 1e-4 for step in (0.01, 0.1) for d in draw.normal(size=(20, len(best))))
    slope = values.T @ (1 / (1 + np.exp(-(values @ weight + bias))) - y) / len(y) + T.RIDGE * weight / len(y)
    assert np.abs(slope).max() < 1e-2


def test_special_rows(spark, docs, clashing):
    rows, labels = corpus(200)
    label = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (7, 0, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(docs(*rows), label)
    df = clashing(docs((None, None), (1, ""), (2, "zorgle " * 30_000), (2, "zorgle " * 30_000)))
    out = T.scored(df, model)
    assert set(out.columns) == set(df.columns)
    scores = [r["score"] for r in out.collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]
    assert T.scored(docs(), model).collect() == []
    none = T.fit(docs(), label.limit(0))
    assert T.scored(docs((1, "x")), none).head()["score"] < 0.01
