"""Near-duplicate documents: an LSH forest over min-hash signatures, exact confirmation on the full shingle sets.

A document's set holds its distinct shingles of ``words`` words, lower-cased in A-Z; a text with fewer words has its
words as one shingle. Two documents are linked if ``100 * intersection >= percent * union``.

1. Documents with equal sets form a class, by 128 bits of a hash; everything below works on classes.
2. A signature has ``TREES`` strings of ``DEPTH`` min-hashes. For each tree the classes are sorted by its string, and
   neighbours in that order whose common prefix has ``LEAST`` values or more are candidates, however many classes share it.
   Sorting is by range, so a large group is spread over tasks; the ends of the ranges are compared afterwards.
3. Candidate components are the groups in which sets are compared. Up to ``BLOCK`` classes they are compared in one task. A larger
   group is dealt into blocks that all hold its first class, the pivot. Whatever isn't connected to the pivot
   then is compared with every block. A link between two classes has an end of the second kind or is inside the pivot's component, so
   none is lost, and no list of pairs is made.

Two classes of similarity s share a prefix of ``LEAST`` in some tree with probability 1 - (1 - s^LEAST)^TREES: all but 4 in
ten million pairs at 0.85, all but 3 in a hundred thousand at 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.components import components
from pastward.llm.shared import Scratch, bit_filter, out_batch, rows_of
from pastward.llm.words import hasher

TREES, DEPTH, LEAST = 20, 8, 4
#: Limits nothing any more; a test of crowded regions sets it.
REGION = 64
BLOCK = 1_024
_KEY = 2 * DEPTH


class Shingler:
    """Shingle hashes (64 bits, sorted, distinct) of a text, and their signature."""

    def __init__(self, words: int):
        import numpy as np

        self.np, self.words, self.hashes = np, words, hasher()
        draw = np.random.Generator(np.random.PCG64(20240301))
        self.multiply = draw.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)

    def __call__(self, text: str | None):
        np, hashed = self.np, self.hashes(text)
        if not len(hashed):
            return hashed
        size = min(self.words, len(hashed))
        joined = np.full(len(hashed) - size + 1, np.uint64(size))
        for k in range(size):
            joined = self.hashes.mixed(joined * self.hashes.base + hashed[k:len(hashed) - size + 1 + k])
        return np.unique(joined)

    def signature(self, shingles) -> bytes:
        """``TREES`` keys of ``DEPTH`` min-hashes; 16 bits of each."""
        np = self.np
        low = np.full(len(self.multiply), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(shingles), 1024):
            part = shingles[None, at:at + 1024] * self.multiply[:, None] + self.add[:, None]
            low = np.minimum(low, part.min(1))
        return self.hashes.mixed(low).astype(np.uint16).astype(">u2").tobytes()


_shinglers: dict[int, Shingler] = {}


def _shingler(words: int) -> Shingler:
    if words not in _shinglers:
        _shinglers[words] = Shingler(words)
    return _shinglers[words]


def _set_key(shingles) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingled(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, text_hash, set_key, signature) of every row; key and signature are null for an empty set or a null id."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("text_hash", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        shingler, out = _shingler(words), [[] for _ in range(5)]
        for doc_id, text, text_hash in rows_of(batches):
            found = shingler(text)
            row = (doc_id, len(found), text_hash, None, None)
            if len(found) and doc_id is not None:
                row = (doc_id, len(found), text_hash, _set_key(found), shingler.signature(found))
            for column, value in zip(out, row):
                column.append(value)
            if len(out[0]) == 2048:
                yield out_batch(schema, out)
                out = [[] for _ in range(5)]
        yield out_batch(schema, out)

    rows = docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(F.col(text_col)))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, text_hash long, set_key binary, signature binary")


def neighbours(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate edges (a, b) between set keys, from all trees."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("part", pa.int32()), ("last", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary())])

    def prefixes(trees, keys):
        """Common prefix, in values, of each row with the one before it."""
        values = np.frombuffer(b"".join(keys), ">u2").reshape(-1, DEPTH)
        same = (values[1:] == values[:-1]) & (trees[1:] == trees[:-1])[:, None]
        return np.cumprod(same, 1).sum(1)

    def run(batches):
        from pyspark import TaskContext

        part, carried, ends = TaskContext.get().partitionId(), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, keys, nodes = (c.to_pylist() for c in batch.columns)
            if carried:
                trees, keys, nodes = [carried[0], *trees], [carried[1], *keys], [carried[2], *nodes]
            else:
                ends.append((trees[0], keys[0], nodes[0]))
            carried = (trees[-1], keys[-1], nodes[-1])
            common = prefixes(np.array(trees), keys)
            found = np.flatnonzero(common >= LEAST)
            if len(found):
                yield out_batch(schema, [[nodes[i] for i in found], [nodes[i + 1] for i in found], *([[None] * len(found)] * 4)])
        if carried:
            ends.append(carried)
            yield out_batch(schema, [[e[2] for e in ends], [None] * 2, [part] * 2, [False, True], [e[0] for e in ends], [e[1] for e in ends]])

    trees = classes.select("set_key", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("tree", F.substring("signature", F.col("tree") * _KEY + 1, F.lit(_KEY)).alias("key"), F.col("set_key").alias("node"))
    order = ["tree", "key", "node"]
    rows = trees.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a binary, b binary, part int, last boolean, tree int, key binary")
    rows = scratch.keep(rows, "neighbours")
    # Two rows per range: the ends of neighbouring ranges are compared here.
    ends = rows.filter("b IS NULL").orderBy("part", "last").collect()
    across = [(bytes(x["a"]), bytes(y["a"])) for x, y in zip(ends[1::2], ends[2::2]) if prefixes(np.array([x["tree"], y["tree"]]), [bytes(x["key"]), bytes(y["key"])])[0] >= LEAST]
    edges = rows.filter("b IS NOT NULL").select("a", "b")
    return edges.unionAll(edges.sparkSession.createDataFrame(across, edges.schema)) if across else edges


def linked_groups(sets: list, percent: int, first: int | None = None) -> list[int]:
    """For each set the number of the first set of its component.

    ``first``: compare only pairs of one of the first so many sets and one of the rest. Counting goes through lists of
    the sets that hold each shingle. Sets of the largest component are passed over, and taken up again if another one
    has become the largest: in the end all sets outside it are counted, and a link between two components has an end there.
    """
    from collections import deque

    import numpy as np

    n = len(sets)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    holders = owner[np.argsort(shingle, kind="stable")]
    counts = np.bincount(shingle)
    begin = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    members = np.ones(n, int)
    waiting, passed = deque(range(n if first is None else first)), 0
    # Ends when all that wait lie in the largest component.
    while passed < len(waiting):
        i = waiting.popleft()
        if first is None and root(i) == members.argmax():
            waiting.append(i)
            passed += 1
            continue
        passed = 0
        own = shingle[ends[i] - sizes[i]:ends[i]]
        lengths = counts[own]
        places = np.repeat(begin[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[places], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            low, high = sorted((root(i), root(j)))
            if low != high and (first is None or j >= first or i == j):
                parent[high] = low
                members[low] += members[high]
                members[high] = 0
    return [root(i) for i in range(n)]


def _confirm(words: int, percent: int):
    """Task body over rows (group, guest, node, text) sorted by them: links (node, root) inside each group.

    Guests of a group are compared with its other rows only.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        shingler = _shingler(words)

        def finish(nodes, sets, guests):
            if len(nodes) < 2 or guests == len(nodes):
                return None
            roots = linked_groups(sets, percent, guests or None)
            pairs = [(nodes[i], nodes[r]) for i, r in enumerate(roots) if i != r]
            return out_batch(schema, [[p[0] for p in pairs], [p[1] for p in pairs]]) if pairs else None

        group, nodes, sets, guests = None, [], [], 0
        for key, guest, node, text in rows_of(batches, 64):
            if key != group:
                if (out := finish(nodes, sets, guests)) is not None:
                    yield out
                group, nodes, sets, guests = key, [], [], 0
            if nodes and nodes[-1] == node:
                continue
            found = shingler(text)
            if _set_key(found) == node:
                nodes.append(node)
                sets.append(found)
                guests += not guest
        if (out := finish(nodes, sets, guests)) is not None:
            yield out

    return run


def confirmed(docs: DataFrame, groups: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): classes that are not the root of their component of links, and the root.

    ``groups``: (node, doc_id, comp) of the classes in candidate components, ``docs``: doc_id, text.
    """
    texts = bit_filter(groups.select("doc_id"), docs.select("doc_id", "text"), "doc_id").join(groups, "doc_id")
    texts = scratch.keep(texts.select("comp", "node", "text"), "texts")
    counts = groups.groupBy("comp").agg(F.count("*").alias("members"), F.min("node").alias("pivot"))
    small = counts.filter(F.col("members") <= BLOCK).select("comp")
    large = scratch.keep(counts.filter(F.col("members") > BLOCK).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "large")
    task = _confirm(words, percent)

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", "guest", "node").mapInArrow(task, "a binary, b binary")

    # ``guest`` sorts first where false; here nobody is one, so all pairs count.
    links = compared(texts.join(small, "comp").select(F.col("comp").alias("group"), F.lit(True).alias("guest"), "node", "text"))
    links = scratch.keep(links, "links")
    if large.isEmpty():
        return links
    members = texts.join(large, "comp")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.withColumn("block", F.explode(F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))))
    group = F.concat_ws("/", F.hex("comp"), "block")
    found = compared(dealt.select(group.cast("binary").alias("group"), F.lit(True).alias("guest"), "node", "text"))
    roots = components(scratch.keep(found, "blocks"), scratch, "blocks_")
    pivots = roots.join(large.select(F.col("pivot").alias("a")), "a", "right").select(F.col("a").alias("pivot"), F.coalesce("b", "a").alias("pivot_root"))
    rest = members.select("comp", "node", "pivot", "blocks").join(roots.withColumnRenamed("a", "node"), "node", "left").join(pivots, "pivot")
    rest = rest.filter(F.coalesce("b", "node") != F.col("pivot_root")).select("comp", "node")
    rest = scratch.keep(rest, "rest")
    left_over = rest.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guest_blocks"))
    hosts = members.join(left_over, "comp").select("comp", "node", "text", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("guest_block"), F.lit(True).alias("guest"))
    guests = members.join(rest, ["comp", "node"]).join(left_over, "comp").select("comp", "node", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "node"), "guest_blocks").cast("int").alias("guest_block"), F.lit(False).alias("guest"))
    group = F.concat_ws("/", F.hex("comp"), "block", "guest_block")
    found = compared(hosts.unionByName(guests).select(group.cast("binary").alias("group"), "guest", "node", "text"))
    return links.unionAll(components(roots.unionAll(scratch.keep(found, "rest_links")), scratch, "rest_"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id (least id of its component), kept (whether it is that one).

    Rows that share an id but not a text are told apart by ``text_hash`` (xxhash64 of the text). An empty table gives an empty one; a text of
    any length is compared as a whole. Null and empty texts, and texts without words, have an empty set and stay alone, as do rows with a null id. Rows
    that repeat an id count as one document for ``kept``. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    rows = scratch.keep(shingled(docs, words, id_col, text_col), "rows")
    classes = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    classes = scratch.keep(classes, "classes")
    candidates = components(neighbours(classes, scratch), scratch, "candidates")
    members = candidates.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(candidates.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    ids = classes.select(F.col("set_key").alias("node"), "doc_id")
    groups = scratch.keep(members.join(ids, "node"), "groups")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    links = confirmed(texts, groups, words, percent, scratch).withColumnRenamed("a", "set_key").withColumnRenamed("b", "root")
    rooted = classes.select("set_key", "doc_id").join(links, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = scratch.keep(rooted.join(least, "root").select("set_key", "component_id"), "linked")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_key").join(linked, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: The result with three words and 85 percent for DuckDB, over the view ``documents``.
SQL = r"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) AS s FROM words WHERE len(w) >= 3
  UNION ALL SELECT doc_id, w FROM words WHERE len(w) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
