import itertools
import random

from pastward.llm import near_dedup as N


def shingles(text, size):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, groups, copies):
    draw = random.Random(seed)
    rows, number = [], 0
    for _ in range(groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(2, 120))]
        for _ in range(draw.randrange(1, copies)):
            words = list(base)
            for _ in range(draw.randrange(0, 6)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(50)}"
            rows.append((number, " ".join(words)))
            number += 1
    draw.shuffle(rows)
    return rows


def got(df, size, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, size, percent).collect()}


def test_same_components_as_brute_force(docs):
    rows = corpus(1, 60, 9)
    assert got(docs(*rows), 3, 85) == brute(rows, 3, 85)
    assert got(docs(*rows), 5, 80) == brute(rows, 5, 80)


def test_large_groups_go_through_blocks(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus(2, 6, 60)
    assert got(docs(*rows), 3, 85) == brute(rows, 3, 85)


def test_crowded_regions_need_longer_prefixes(docs, monkeypatch):
    monkeypatch.setattr(N, "REGION", 4)
    rows = corpus(3, 10, 40)
    assert got(docs(*rows), 3, 85) == brute(rows, 3, 85)


def test_special_rows(docs, clashing):
    df = docs((5, "Aa bB"), (3, "aa BB"), (4, "ÄA bb"), (6, "äa bb"), (7, None), (8, ""), (9, " \n"), (None, "aa bb"), (2, "q r s t"), (2, "q r s t"))
    rows = N.near_duplicates(clashing(df), 3, 85).collect()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 10
    assert found == {(5, 1, 3, False), (3, 1, 3, True), (4, 1, 4, True), (6, 1, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 1, None, True), (2, 2, 2, True)}


def test_empty_table(docs):
    assert N.near_duplicates(docs()).collect() == []


def test_two_clusters_joined_by_one_link_in_all_orders():
    import numpy as np

    # Two and three sets with the link 1-3 between them; linked sets share ten shingles that no other set has.
    links = [(0, 1), (1, 3), (2, 3), (2, 4), (3, 4)]
    sets = [np.concatenate([np.arange(10 * k, 10 * k + 10, dtype=np.uint64) for k, link in enumerate(links) if i in link]) for i in range(5)]
    for order in itertools.permutations(range(5)):
        assert N.linked_groups([sets[i] for i in order], 25) == [0] * 5, order
        apart = [sets[i] if i != 3 else sets[i][10:] for i in order]
        roots = N.linked_groups(apart, 25)
        assert len({roots[order.index(i)] for i in (0, 1)}) == len({roots[order.index(i)] for i in (2, 3, 4)}) == 1 and len(set(roots)) == 2


def test_crowded_regions_keep_their_short_prefixes(spark):
    import numpy as np

    from pastward.llm.shared import Scratch

    # 100 classes share four values in the first order only, and each of 50 pairs all eight of them.
    keys = np.random.default_rng(5).integers(0, 1 << 16, (100, N.TREES, N.DEPTH)).astype(">u2")
    keys[:, 0, :4] = 7
    keys[1::2, 0] = keys[::2, 0]
    rows = [(bytes([i]), keys[i].tobytes()) for i in range(100)]
    edges = N.neighbours(spark.createDataFrame(rows, "set_key binary, signature binary"), Scratch(spark, "near_dedup")).collect()
    assert len({frozenset((bytes(a), bytes(b))) for a, b in edges}) == 99
