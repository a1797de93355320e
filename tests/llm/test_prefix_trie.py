import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pastward.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def drawn(seed, count):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(0, 400), count):
        for turn in range(draw.randrange(1, 9)):
            rows.append((c, turn, draw.choice("ua"), draw.choice(["x", "yy", "zß€", ""])))
    return rows


@pytest.mark.parametrize("shard_rows", [1, 5, 37, 10_000])
def test_equals_brute_force(spark, shard_rows):
    for seed in (1, 2):
        rows = drawn(seed, 60)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            got = sorted((tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df, shard_rows).collect()), key=repr)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == brute(rows)


def test_special_rows(spark, clashing):
    copies = [(c, t, "u", "same") for c in range(200, 260) for t in range(7)]
    rows = [*copies, (None, 0, "u", "lost"), (5, None, None, None), (5, 1, "u", "b"), (5, 1, "u", "a"), (5, 1, "u", "a"), (7, 0, "u", "only"), (300, 0, "a", "é" * 50_000)]
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("depth", P.F.lit("x")).withColumn("d1", P.F.lit("y"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df, 50).collect()), key=repr)
    assert got == brute(rows)
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_turnless_conversation_ends_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]
    row = P.prefix_trie(spark.createDataFrame(rows, SCHEMA)).head()
    assert (row["conv_id"], row["depth"], row["n_convs"], row["n_leaves"]) == (c, 0, 1, 1)
    assert row["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_ends_of_a_node_in_pieces(spark, monkeypatch):
    rows = [(c, d, 1, 2, 0, 0, 0, True) for d in (0,) for c in range(1, 1001)]
    monkeypatch.setattr(P, "ENDS_IN_PIECE", 64)
    prefixes = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows], P._ROWS).repartition(4)
    got = P.end_hashes(prefixes).collect()
    assert len(got) == 1 and got[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1, 1001))).encode()).hexdigest()


def test_slots_are_minimal_perfect_and_verified():
    draw = np.random.Generator(np.random.PCG64(5))
    for size in (0, 1, 2, 1000):
        keys = draw.integers(-(1 << 63), 1 << 63, (2, size), dtype=np.int64)
        keys[0, : size // 2] = 17  # halves alone need not be distinct
        table = P.SlotTable(*keys)
        assert sorted(table.slots(*keys).tolist()) == list(range(size))
        others = draw.integers(-(1 << 63), 1 << 63, (2, 500), dtype=np.int64)
        assert (table.slots(*others) == -1).all()
