import math
from collections import Counter, defaultdict

from pastward.llm import mixing as M


def corpus():
    rows = []
    for source, count in (("big", 300), ("mid", 80), ("small", 40), (None, 30)):
        for _ in range(count):
            k = len(rows)
            rows.append((k, " ".join(["w"] * (1 + k * 7 % 20)), source))
    return rows


def test_repetition_limit_and_whole_epochs(docs):
    rows = corpus()
    plan = M.schedule(docs(*rows), entropy=1.0, repetitions=2.0, block_tokens=500).collect()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len(text.split()) + 1
    used, times = Counter(), Counter()
    for r in plan:
        used[r["source"]] += r["n_tokens"]
        times[r["doc_id"]] += 1
    assert set(times) == {r[0] for r in rows}  # nothing is lost
    assert {times[k] for k, _, s in rows if s == "big"} == {1}
    shares = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    least = min(shares, key=shares.get)
    assert 1.9 * tokens[least] <= used[least] <= 2 * tokens[least]
    a = 1 - math.log(2) / math.log(max(shares.values()) / shares[least])
    z = sum(p ** a for p in shares.values())
    for s, p in shares.items():
        assert abs(used[s] / sum(used.values()) - p ** a / z) < 0.03
    places = defaultdict(list)
    for r in plan:
        places[r["block"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert set(places) == set(range(max(places) + 1))


def test_entropy_target(spark):
    shares = [0.7, 0.2, 0.1]
    sources = spark.createDataFrame([(p,) for p in shares], "share double")
    a = M.temperature(sources, entropy=0.95, repetitions=None)

    def entropy(a):
        w = [p ** a for p in shares]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(3)

    assert entropy(a) >= 0.95 > entropy(a + 1e-6)
    assert M.temperature(sources, entropy=0.5, repetitions=None) == 1.0
    limited = M.temperature(sources, entropy=0.95, repetitions=1.2)
    assert abs((0.7 / 0.1) ** (1 - limited) - 1.2) < 1e-6


def test_budget_in_many_ranges(docs, monkeypatch):
    monkeypatch.setattr(M, "RANGE_DOCUMENTS", 10)
    rows = corpus()
    plan = M.schedule(docs(*rows), entropy=None, repetitions=None, budget=1500, block_tokens=300).collect()
    total, used, all_tokens = Counter(), Counter(), 0
    for _, text, s in rows:
        total[s] += len(text.split()) + 1
    for r in plan:
        used[r["source"]] += r["n_tokens"]
    for s, n in total.items():
        quota = 1500 * n / sum(total.values())
        assert quota - 21 <= used[s] <= quota
    assert max(Counter(r["doc_id"] for r in plan).values()) == 1


def test_special_rows(docs, clashing):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", "a"), (2, "", None), (3, "long " * 20_000, "b")]
    df = clashing(docs(*rows))
    out = M.mixed(df, repetitions=1.0)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert M.schedule(docs()).collect() == [] and M.mixed(docs()).collect() == []
