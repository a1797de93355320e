import math
import random
from collections import Counter

import pytest

from pastward.llm import lexical_search as S
from pastward.llm.shared import Scratch


def brute(rows, queries, k):
    bags = [(d, Counter("".join(c.lower() if c.isascii() else c for c in t or "").split())) for d, t in rows]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for q, text in queries:
        asked = set("".join(c.lower() if c.isascii() else c for c in text or "").split())
        found = []
        for d, bag in bags:
            units = sum(round(1e6 * (math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))))) for t in asked if t in bag)
            if units > 0:
                found.append((-units, d is None, d or 0, d))
        out += [(q, r, f[3], -f[0] / 1e6) for r, f in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(seed, count):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for d in range(count):
        rows.append((d, " ".join(words[int(400 * draw.random() ** 3)] for _ in range(draw.randrange(1, 60)))))
        if d % 7 == 0 and rows:
            rows[-1] = (d, draw.choice(rows)[1])
    return rows


@pytest.mark.parametrize("shard, segment, block", [(8192, 16384, 512), (40, 25, 3)])
def test_same_as_brute_force(spark, docs, monkeypatch, shard, segment, block):
    monkeypatch.setattr(S, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(S, "SEGMENT_DOCUMENTS", segment)
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    rows = corpus(3, 300)
    queries = [r for r in rows if r[0] % 20 == 0]
    scratch = Scratch(spark, "test")
    found = S.search(S.index(docs(*rows), scratch), spark.createDataFrame(queries, "query_id long, text string"), scratch, 5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, queries, 5))


def merged(spark, docs, count):
    """Segments of ``count`` documents, rows that their groups return, and the groups."""
    rows = corpus(5, count)
    scratch = Scratch(spark, "test")
    found = S.search(S.index(docs(*rows), scratch), spark.createDataFrame(rows[:12], "query_id long, text string"), scratch, 4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, rows[:12], 4))
    segments = spark.read.parquet(scratch.path("segments"))
    words, documents = segments.selectExpr("sum(words)", "sum(documents)").head()
    packed = spark.read.parquet(scratch.path("query_blocks"))
    best = S._best_of_groups(segments, packed, Scratch(spark, "test"), segments.count(), documents, words / documents, 4)
    return segments.count(), best.count(), {r["group"] for r in spark.read.parquet(scratch.path("groups")).collect()}


def test_rows_to_merge_do_not_grow_with_shards(spark, docs, monkeypatch):
    """Each shard returned its best of every query, and got every query block."""
    for name, value in (("GROUPS", 3), ("SEGMENT_DOCUMENTS", 5), ("SHARD_DOCUMENTS", 5), ("QUERY_BLOCK", 5), ("HELD_QUERIES", 64)):
        monkeypatch.setattr(S, name, value)
    for count in (60, 400):
        segments, rows, groups = merged(spark, docs, count)
        assert segments >= count / 5 and rows <= 3 * 12 * 4 and groups == {0, 1, 2}


def test_best_of_earlier_shards_take_part(spark):
    """Ties go by id over shards, a null id last, and a later shard does not score what cannot enter."""
    import numpy as np

    from pastward.llm.words import hasher

    def segment(number, *rows):
        found = [np.unique(hasher()(t), return_counts=True) for _, t in rows]
        return tuple(S._segment(number, [d for d, _ in rows], found, [len(t.split()) for _, t in rows])[3:])

    block = S._query_blocks(spark.createDataFrame([(7, int(hasher()("a").view(np.int64)[0]), 5)], "query_id long, term long, documents long"), 1).head()["data"]
    parts = [segment(0, (None, "a"), (9, "a b")), segment(1, (4, "a"), (5, "c")), segment(2, (3, "a b c d"), (2, "a"))]
    group = S.Group(6, 1.5, 3, 2, 8)
    group.ask(bytes(block))
    for part in parts:
        group.add(part)
    (found,) = group.close()
    assert found.column("doc_id").to_pylist() == [2, 4, None] and len(set(found.column("units").to_pylist())) == 1
    assert set(found.column("query_id").to_pylist()) == {7}


def test_bounds_leave_documents_out():
    """The k best are found without scoring all documents that have a term of the query."""
    import numpy as np

    draw = random.Random(1)
    texts = [("common " * draw.randrange(1, 9) + f"r{k % 90} x{k}").split() for k in range(2000)]
    from pastward.llm.words import hasher

    found = [np.unique(hasher()(" ".join(t)), return_counts=True) for t in texts]
    row = S._segment(0, list(range(2000)), found, [len(t) for t in texts])
    shard = S.Shard([row[3:]])
    assert len(shard.ids) == 2000 and len(shard.terms) == 2091


def test_few_documents_are_summed_one_by_one(spark, monkeypatch):
    """Most documents have most of the terms; all of a query's were gathered by steps until the bounds, which are alike, ended it."""
    import numpy as np

    from pastward.llm.words import hasher

    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(40, 80))) for _ in range(1500)]
    texts += texts[:30]  # ties
    found = [np.unique(hasher()(t), return_counts=True) for t in texts]
    shard = S.Shard([S._segment(0, list(range(len(texts))), found, [len(t.split()) for t in texts])[3:]])
    mean, total = sum(len(t.split()) for t in texts) / len(texts), 10**9
    rows = [(q, int(t)) for q in range(20) for t in found[q][0].view(np.int64)]
    df = {int(t): int(n) for t, n in zip(*np.unique(np.concatenate([t for t, _ in found]).view(np.int64), return_counts=True))}
    block = S._query_blocks(spark.createDataFrame([(q, t, df[t]) for q, t in rows], "query_id long, term long, documents long"), 1).head()["data"]
    sums, summed = [], S._summed
    monkeypatch.setattr(S, "_summed", lambda dense, own, kept: (sums.append(len(kept)), summed(dense, own, kept))[1])
    queries, scored, ids, _ = shard.best(bytes(block), total, mean, 10)
    units = np.zeros((20, len(texts)), np.int64)
    place = {int(t): k for k, t in enumerate(shard.terms.view(np.int64))}
    for q, t in rows:
        at = np.arange(shard.starts[place[t]], shard.ends[place[t]])
        idf = np.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5))
        units[q, shard.documents[at]] += shard._values(at, np.full(len(at), idf), mean)
    assert queries.tolist() == list(range(20))
    for q in range(20):
        order = np.lexsort((shard.ids, -units[q]))[:10]
        assert ids[q].tolist() == shard.ids[order].tolist() and scored[q].tolist() == units[q, order].tolist()
    assert len(sums) == 20 and max(sums) <= 20


def test_special_rows(spark, docs, clashing):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "A B"), (4, "a b"), (None, "a z"), (5, "only once"), (6, "word " * 50_000)]
    queries = [(7, "a b"), (7, "b"), (8, None), (9, "unknown"), (None, "a")]
    scratch = Scratch(spark, "test")
    got = S.search(S.index(clashing(docs(*rows)), scratch), spark.createDataFrame(queries, "query_id long, text string"), scratch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute(rows, [(7, "a b")], 10), key=repr)
    none = Scratch(spark, "test")
    assert S.search(S.index(docs(), none), spark.createDataFrame(queries, "query_id long, text string"), none).collect() == []
    assert S.search(S.index(docs(*rows), none.__class__(spark, "t")), spark.createDataFrame([], "query_id long, text string"), Scratch(spark, "t")).collect() == []
