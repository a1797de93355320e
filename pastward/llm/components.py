"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import Scratch


def _forest(batches):
    """Edges of a spanning forest of the edges that a task sees: each node with the least of its tree."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    limit = 200_000
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def stars():
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], schema=schema)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        if len(parent) > limit:
            yield stars()
    yield stars()


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One half of a star round: every node's larger (or smaller) neighbours are moved to the least node around it.

    Minima are aggregated before they are joined back, so a node with many edges is no list in one task.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = both.join(least, "a").filter("b > a" if larger else "b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        moved = moved.unionAll(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): every node that isn't the least of its component, and that least node.

    ``edges``: columns a, b, binary and not null. Rounds of stars around least nodes until no edge changes; a round's
    table is written to the shared folder, and the one before it removed.
    """
    edges = edges.filter("a <> b").select("a", "b").mapInArrow(_forest, "a binary, b binary")
    current = scratch.keep(edges.distinct(), f"{name}0")
    before, turn = None, 0
    while True:
        turn += 1
        current = scratch.keep(_stars(_stars(current, True), False), f"{name}{turn}")
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).head()
        scratch.drop(f"{name}{turn - 1}")
        if mark == before:
            return current
        before = mark
