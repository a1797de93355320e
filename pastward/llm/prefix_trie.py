"""Prefix trie of conversations over minimal-perfect-hash node tables.

A node is a distinct sequence of first turns; its name is a 128-bit digest, chained turn by turn. A shard is a run of at most
``SHARD_ROWS`` (conversation, depth) rows. For each shard the distinct digests get slots of a minimal perfect hash, every
lookup is verified against the digest kept in the slot, and counts, ends and parent slots are flat numpy arrays over the slots. Sums over
subtrees run through the parent slots, deepest nodes first.

Everything a shard gives is additive over conversations, so shards need not follow the tree: a prefix that a third of all
conversations share has one row per shard, added up with map-side combine, and no task ever holds a subtree. Two passes:

1. members, least member and ends of every node;
2. with the least member known, each node's characters are counted for all its members but that one, and each leaf for its least
   member; summed up the parent slots these are ``saved_tokens`` and ``n_leaves``.

A conversation's turns stream through one task in order, with a bounded state. A conversation may be cut between shards: the
second pass goes from its end to the root and hands its sum on.
The hash over a node's member ids is sequential by definition: ids are joined to long pieces in many tasks, one task reads the pieces.

Null and repeated rows: null roles and texts count as empty, repeated rows are turns of their own, equal turn numbers are ordered by role and
text. Rows without ``conv_id`` belong to no conversation. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import Scratch, out_batch, rows_of

#: The rule by which conversations are rebuilt: fixed values.
GROUP, HEADS = 100, 6
SHARD_ROWS = 1 << 17
ENDS_IN_PIECE = 1 << 15
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
_KEY = ("d1", "d2")
_ROWS = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, chars long, is_end boolean"


class SlotTable:
    """Slots 0 … n-1 for n distinct pairs of 64-bit numbers: levels of bits, each placing the keys that are alone at their bit."""

    def __init__(self, first, second):
        import numpy as np

        self.np = np
        first, second = first.astype(np.uint64), second.astype(np.uint64)
        self.levels = []
        self.kept = np.zeros((2, len(first)), np.uint64)
        rest, placed = np.arange(len(first)), 0
        while len(rest):
            size = len(rest) + len(rest) // 2 + 1
            at = self._hash(first[rest], second[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + placed
            own = alone[at]
            self.kept[:, rank[at[own]]] = first[rest[own]], second[rest[own]]
            self.levels.append((size, alone, rank))
            placed += int(own.sum())
            rest = rest[~own]

    def _hash(self, first, second, level, size):
        np = self.np
        x = (first + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9) ^ (second >> np.uint64(31))
        x = (x ^ second ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def __len__(self):
        return self.kept.shape[1]

    def slots(self, first, second):
        """The slot of every key, -1 for keys that aren't in the table."""
        np = self.np
        first, second = first.astype(np.uint64), second.astype(np.uint64)
        found = np.full(len(first), -1)
        rest = np.arange(len(first))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._hash(first[rest], second[rest], level, size)
            own = alone[at]
            slot, key = rank[at[own]], rest[own]
            same = (self.kept[0, slot] == first[key]) & (self.kept[1, slot] == second[key])
            found[key[same]] = slot[same]
            rest = rest[~own]
        return found


def _table_of(first, second) -> SlotTable:
    import numpy as np

    pairs = np.unique(np.stack([first, second], 1), axis=0)
    return SlotTable(pairs[:, 0], pairs[:, 1])


def _shards(batches, size):
    """Numpy columns of at least ``size`` rows, the last one excepted."""
    import numpy as np

    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= size:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, origin, key, chars) in tasks, in the order of turns: first turns lent by the group's conversation (origin 0), then own ones.

    Lent turns carry a digest and a length, no text. They are made for every possible borrower; the scan drops those of absent ones.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    key = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("key")
    first = F.row_number().over(_by("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    lent = own.filter(F.col("conv_id") % GROUP == 0).withColumn("at", first).filter(F.col("at") < HEADS)
    lent = lent.select(F.col("conv_id").alias("base"), "at", key, F.length("text").cast("long").alias("chars"))
    lent = lent.withColumn("conv_id", F.explode(F.sequence(F.col("base") - (GROUP - 1), F.col("base") + (GROUP - 1))))
    lent = lent.filter((F.col("conv_id") != F.col("base")) & (F.col("conv_id") - F.col("conv_id") % GROUP == F.col("base")))
    lent = lent.filter(F.col("at") <= F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    none = F.lit(None).cast("string")
    both = own.select("conv_id", F.lit(1).alias("origin"), F.col("turn").cast("long").alias("turn"), "role", "text", key, F.length("text").cast("long").alias("chars")).unionByName(
        lent.select("conv_id", F.lit(0).alias("origin"), F.col("at").cast("long").alias("turn"), none.alias("role"), none.alias("text"), "key", "chars"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "origin", F.asc_nulls_first("turn"), "role", "text")
    return both.select("conv_id", "origin", "key", "chars")


def _by(*columns):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def _prefixes(batches):
    """A row for every prefix of every rebuilt conversation, the root's included, from the rows of ``rebuilt_turns``."""
    import pyarrow as pa

    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "d1", "d2", "p1", "p2", "chars")] + [("is_end", pa.bool_())])
    done: list[tuple] = []
    pending, conv, heads, own, skip, depth, digest = None, None, [], 0, 0, 0, ROOT

    def put(parent, digest, chars):
        nonlocal pending
        if pending is not None:
            done.append((*pending, False))
        pending = (conv, depth, *struct.unpack("<qq", digest), *struct.unpack("<qq", parent), chars)

    for conv_id, origin, key, chars in rows_of(batches, 4096):
        if conv_id != conv:
            if pending is not None:
                done.append((*pending, True))
            pending, conv, heads, own, depth, digest = None, conv_id, [], 0, 0, ROOT
            skip = zlib.crc32(str(conv_id).encode()) % HEADS if conv_id % GROUP else 0
        if origin == 0:
            heads.append((key, chars))
            continue
        own += 1
        steps = [(key, chars)] if own > skip else []
        if own == 1:
            put(bytes(16), ROOT, 0)
            steps = heads + steps
        for step, size in steps:
            parent, depth = digest, depth + 1
            digest = hashlib.blake2b(parent + step, digest_size=16).digest()
            put(parent, digest, size)
        if len(done) >= 16_384:
            yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])
            done = []
    if pending is not None:
        done.append((*pending, True))
    if done:
        yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])


def _counted(shard_rows):
    def run(batches):
        """Members, least member and ends of the nodes of each shard."""
        import numpy as np
        import pyarrow as pa

        names = ("d1", "d2", "p1", "p2", "depth", "chars", "conv_id", "n_convs", "n_ends")
        for conv_id, depth, d1, d2, p1, p2, chars, is_end in _shards(batches, shard_rows):
            table = _table_of(d1, d2)
            slot = table.slots(d1, d2)
            least = np.full(len(table), np.iinfo(np.int64).max)
            np.minimum.at(least, slot, conv_id)
            columns = []
            for column in (d1, d2, p1, p2, depth, chars):
                flat = np.zeros(len(table), np.int64)
                flat[slot] = column
                columns.append(flat)
            columns += [least, np.bincount(slot, minlength=len(table)), np.bincount(slot[is_end.astype(bool)], minlength=len(table))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    return run


def _accumulated(shard_rows):
    def run(batches):
        """Sums over the subtrees of each shard; rows of a conversation come from its end to the root, after its mark (depth null)."""
        import numpy as np
        import pyarrow as pa

        mark, carry = None, None  # of the conversation that the last shard ended in
        for conv_id, depth, d1, d2, p1, p2, chars, is_end, own_from, own_leaf in _shards(batches, shard_rows):
            is_mark = depth < 0
            last = np.maximum.accumulate(np.where(is_mark, np.arange(len(depth)), -1))
            valid = (last >= 0) & (conv_id[last] == conv_id)
            since, leaf = np.where(valid, own_from[last], np.iinfo(np.int64).max), np.where(valid, own_leaf[last], 0)
            if mark is not None:
                held = ~valid & (conv_id == mark[0])
                since, leaf = np.where(held, mark[1], since), np.where(held, mark[2], leaf)
            mark = (conv_id[-1], since[-1], leaf[-1])
            row = ~is_mark
            if not row.any():
                continue
            conv_id, depth, d1, d2, p1, p2 = (c[row] for c in (conv_id, depth, d1, d2, p1, p2))
            saved, leaves = np.where(depth < since[row], chars[row], 0), np.where(is_end[row].astype(bool), leaf[row], 0)
            if carry is not None and carry[0] == conv_id[0]:
                saved[0], leaves[0] = saved[0] + carry[1], leaves[0] + carry[2]
            table = _table_of(d1, d2)
            slot = table.slots(d1, d2)
            sums, level, parent = np.zeros((2, len(table)), np.int64), np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
            np.add.at(sums[0], slot, saved)
            np.add.at(sums[1], slot, leaves)
            level[slot], parent[slot] = depth, table.slots(p1, p2)
            order = np.argsort(-level, kind="stable")
            bounds = np.flatnonzero(np.diff(level[order])) + 1
            for nodes in np.split(order, bounds):
                inner = nodes[parent[nodes] >= 0]
                np.add.at(sums[0], parent[inner], sums[0, inner])
                np.add.at(sums[1], parent[inner], sums[1, inner])
            # only the last conversation can be cut; where its next node is here, through another one, the sum has gone up already
            end = slot[-1]
            carry = (conv_id[-1], sums[0, end], sums[1, end]) if depth[-1] > 0 and parent[end] < 0 else None
            columns = [table.kept[0].astype(np.int64), table.kept[1].astype(np.int64), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d1", "d2", "saved_tokens", "n_leaves"])

    return run


def _joined_ids(batches):
    """Decimal ids of the conversations that end at a node, comma-joined in pieces; rows come in the order of node and id."""
    import pyarrow as pa

    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, first, ids, done, size = None, 0, [], [], 0
    for d1, d2, conv_id in rows_of(batches, 4096):
        if (d1, d2) != node or len(ids) >= ENDS_IN_PIECE:
            if ids:
                done.append((*node, first, ",".join(ids)))
                size += len(ids)
            node, first, ids = (d1, d2), conv_id, []
            if size >= 4 * ENDS_IN_PIECE or len(done) >= 16_384:
                yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])
                done, size = [], 0
        ids.append(str(conv_id))
    if ids:
        done.append((*node, first, ",".join(ids)))
    if done:
        yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])


def _hashed_ids(batches):
    """SHA-256 of the pieces of a node, in the order of their first ids."""
    import pyarrow as pa

    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])
    node, state, done = None, None, []
    for d1, d2, ids in rows_of(batches, 16):
        if (d1, d2) == node:
            state.update(b",")
        else:
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (d1, d2), hashlib.sha256()
            if len(done) >= 16_384:
                yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])
                done = []
        state.update(ids.encode())
    if node is not None:
        done.append((*node, state.hexdigest()))
    if done:
        yield out_batch(schema, [list(c) for c in zip(*done, strict=True)])


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the nodes at which conversations end; a node of any number of ends is spread over tasks by ranges of ids."""
    ends = prefixes.filter("is_end").select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = ends.mapInArrow(_joined_ids, "d1 long, d2 long, first long, ids string")
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").select(*_KEY, "ids")
    return pieces.mapInArrow(_hashed_ids, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, turn, role, text) after rebuilding the conversations.

    Rows: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    prefixes = scratch.keep(rebuilt_turns(turns).mapInArrow(_prefixes, _ROWS), "prefixes")
    parts = prefixes.mapInArrow(_counted(shard_rows), "d1 long, d2 long, p1 long, p2 long, depth long, chars long, conv_id long, n_convs long, n_ends long")
    same = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars", "conv_id")]  # equal in all parts of a node, but for the least member
    nodes = scratch.keep(parts.groupBy(*_KEY).agg(*same, F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends")), "nodes")

    # the nodes of which a conversation is the least member are the deepest of its path
    marks = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("own_leaf"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("d1", "d2", "p1", "p2", "chars")]
    marks = marks.select("conv_id", F.lit(-1).cast("long").alias("depth"), *zero, F.lit(False).alias("is_end"), "own_from", "own_leaf")
    none = [F.lit(0).cast("long").alias(c) for c in ("own_from", "own_leaf")]
    down = prefixes.select("*", *none).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("depth") >= 0, F.desc("depth"))
    sums = down.mapInArrow(_accumulated(shard_rows), "d1 long, d2 long, saved_tokens long, n_leaves long")

    # everything that is added up by node in one shuffle: the node itself, its sums by shard, one row for each of its children
    columns = ("p1", "p2", "depth", "conv_id", "n_convs", "n_children", "saved_tokens", "n_leaves")

    def padded(df, **given):
        return df.select(*_KEY, *[given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast("long").alias(c) for c in columns])

    children = nodes.filter("depth > 0").select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.lit(1).alias("n_children"))
    every = padded(nodes).unionByName(padded(sums)).unionByName(padded(children))
    kept = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id", "n_convs")]
    added = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_children", "saved_tokens", "n_leaves")]
    every = every.groupBy(*_KEY).agg(*kept, *added)
    parents = nodes.filter("n_ends < n_convs").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    every = every.join(parents, ["p1", "p2"], "left").join(end_hashes(prefixes), list(_KEY), "left")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


#: crc32 of a decimal number, from its table of 256 entries by rule.
_CRC = """(SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS entries)"""
SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM turns GROUP BY conv_id
), counted AS (
    SELECT conv_id, turns, CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS BIGINT) AS h
    FROM own, {_CRC}
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
    FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {GROUP}
), paths AS (
    SELECT conv_id, depth, md5(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS node, md5(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) AS parent,
        CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS chars, depth = len(turns) AS is_end
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, min(parent) AS parent, min(chars) AS chars, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
    FROM paths GROUP BY node, depth
), children AS (
    SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth
), sums AS (
    SELECT p.node, p.depth, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (WHERE c.parent IS NULL) AS n_leaves
    FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.parent = n.node AND c.depth = n.depth
    GROUP BY p.node, p.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
LEFT JOIN children c ON c.parent = n.node AND c.depth = n.depth
"""
