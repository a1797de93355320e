"""Bytes covered by strings of ``length`` bytes that start in more than one place of a corpus.

The method merges Burrows-Wheeler orders of shards by interleave refinement, over a sample of the suffixes:

1. *Anchors* are byte positions chosen by content, the least hash of ``GRAM`` bytes in each window of ``window`` positions. Two equal
   strings of ``length`` bytes have an anchor at the same place in their first ``window`` bytes, and from it at least
   ``length - window + 1`` bytes in common, its *core*. A string is thus the core of an anchor, up to ``window - 1`` bytes to the
   left of it and so many to the right that they make ``length``.
2. Anchors are sorted by a hash of the core, then by one of everything within reach. Where all within reach is equal, every string
   through both anchors is repeated. A core that no other anchor has is done, too.
3. What is left, distinct surroundings of equal cores, are the suffixes to merge. They start as one block per core, a
   shard's behind another's. A round refines the interleave by one more symbol: the blocks of the suffix order by the next byte to the right, those of the
   order of the reversed texts by the preceding byte, which is the transform's own column. The depth at which two neighbours
   part is their common prefix; no suffix is compared twice, and nothing is sorted anew. A string with j bytes to the left is repeated
   if its block at depth j to the left and the rest to the right holds a second suffix.

All suffixes, refined for ``length`` rounds, would be ``length`` passes over every byte of the corpus; this way a
round handles an anchor, one in about ``window / 2`` bytes, and only those that share a core. Cores are compared by 64 bits of a hash
and, with their surroundings, by 128.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import Scratch, bit_filter, out_batch, rows_of

LENGTH = 200
WINDOW = 104
GRAM = 8
#: Bytes hashed at once, and surroundings refined at once. A core with more surroundings is handled in parts.
CHUNK_BYTES = 1 << 18
CHUNK_SUFFIXES = 30_000
_NULL_ID = -(1 << 63)
_FULL, _PARTNER, _OPEN = 0, 1, 2
_ANCHORS = "core long, reach long, doc_id long, text_hash long, pos int"
_MARKS = "doc_id long, text_hash long, pos int, kind byte, core long"


class _Hashes:
    """Hashes of stretches of bytes, from running sums."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.of_byte = np.random.Generator(np.random.PCG64(20240302)).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self._grow(CHUNK_BYTES + 1)

    def _grow(self, size: int) -> None:
        np = self.np
        for name, value in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
            setattr(self, name, np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(value))]), dtype=np.uint64))

    def sums(self, data):
        np = self.np
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[:len(data)], out=out[1:])
        return out

    def mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _least(values, window: int, pick):
    """``pick`` (minimum or maximum) of every window."""
    size = 1
    while 2 * size <= window:
        values = pick(values[:-size], values[size:])
        size *= 2
    return values if size == window else pick(values[:len(values) - window + size], values[window - size:])


def find_anchors(hashes: _Hashes, texts: list[bytes], length: int, window: int):
    """(text number, position in it, hash of the core, hash of all within reach) of all anchors of some texts.

    The texts are hashed as one; anchors that only a window over the end of a text has chosen do no harm.
    """
    import numpy as np

    data = np.frombuffer(b"".join(texts), np.uint8)
    core = length - window + 1
    none = np.zeros(0, np.int64)
    if len(data) < max(length, window + GRAM):
        return none, none, none, none
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    sums = hashes.sums(data)
    grams = (hashes.mixed((sums[GRAM:] - sums[:-GRAM]) * hashes.down[:len(data) - GRAM + 1]) >> np.uint64(32)).astype(np.uint32)
    low = _least(grams, window, np.minimum)
    edge = np.zeros(window - 1, np.uint32)
    anchors = np.flatnonzero(_least(np.concatenate([edge, low, edge]), window, np.maximum) == grams)
    text = np.searchsorted(ends, anchors, "right")
    begin, end = ends[text] - sizes[text], ends[text]
    fits = (anchors + core <= end) & (sizes[text] >= length)
    anchors, text, begin, end = anchors[fits], text[fits], begin[fits], end[fits]
    left, right = np.maximum(anchors - window + 1, begin), np.minimum(anchors + length, end)
    inner = hashes.mixed((sums[anchors + core] - sums[anchors]) * hashes.down[anchors])
    outer = (sums[right] - sums[left]) * hashes.down[left] + (anchors - left).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (right - anchors).astype(np.uint64)
    return text, anchors - begin, inner.view(np.int64), hashes.mixed(outer).view(np.int64)


def _anchor_rows(length: int, window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("core", pa.int64()), ("reach", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])
        hashes, held, size = _Hashes(), [], 0

        def close():
            ids, texts, codes = zip(*held)
            text, pos, core, reach = find_anchors(hashes, list(texts), length, window)
            return pa.RecordBatch.from_arrays([
                pa.array(core), pa.array(reach), pa.array(np.array(ids, np.int64)[text]), pa.array(np.array(codes, np.int64)[text]), pa.array(pos.astype(np.int32)),
            ], schema=schema)

        for doc_id, data, code in rows_of(batches, 64):
            held.append((doc_id, data, code))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return run


def _classify(batches):
    """Marks of anchors sorted by core and reach. A row is judged when its neighbours in that order are known."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8()), ("core", pa.int64())])

    def judged(columns, first: int, last: int):
        core, reach, doc, code, pos = columns
        same_core = np.concatenate([[False], core[1:] == core[:-1], [False]])
        same = np.concatenate([[False], (core[1:] == core[:-1]) & (reach[1:] == reach[:-1]), [False]])
        full = same[:-1] | same[1:]
        other = (same_core[:-1] & ~same[:-1]) | (same_core[1:] & ~same[1:])
        out = []
        for kind, chosen in ((_FULL, full), (_PARTNER, full & other), (_OPEN, ~full & other)):
            found = np.flatnonzero(chosen)
            found = found[(found >= first) & (found < last)]
            if len(found):
                out.append(pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(code[found]), pa.array(pos[found]), pa.array(np.full(len(found), kind, np.int8)), pa.array(core[found])], schema=schema))
        return out

    held, first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        yield from judged(columns, first, len(columns[0]) - 1)
        first = min(1, len(columns[0]) - 1)
        held = [c[-2:] for c in columns]
    if held is not None:
        yield from judged(held, len(held[0]) - 1, len(held[0]))


def _surroundings(length: int, window: int):
    """(core, doc_id, text_hash, pos, open, left, right) from texts and their marks; ``left`` is reversed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        schema = pa.schema([("core", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
        unpack, core_size = zstandard.ZstdDecompressor().decompress, length - window + 1
        for doc_id, code, data, marks in rows_of(batches, 64):
            data = unpack(data)
            out = [[] for _ in range(7)]
            for mark in marks:
                pos = mark["pos"]
                row = (mark["core"], doc_id, code, pos, mark["kind"] == _OPEN, data[max(0, pos - window + 1):pos][::-1], data[pos + core_size:pos + length])
                for column, value in zip(out, row):
                    column.append(value)
            yield out_batch(schema, out)

    return run


def refine(blocks, symbols):
    """Number of the block of each suffix after one more symbol: blocks stay in order and split by symbol."""
    import numpy as np

    keys = blocks.astype(np.int64) * 257 + symbols
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


def _columns(sides: list[bytes], depth: int):
    """Symbols by depth: bytes, and 256 beyond the end of a text; and the sizes."""
    import numpy as np

    sizes = np.array([len(s) for s in sides])
    table = np.frombuffer(b"".join(s.ljust(depth, b"\0") for s in sides), np.uint8).reshape(len(sides), depth).astype(np.int16)
    table[np.arange(depth)[None, :] >= sizes[:, None]] = 256
    return table.T, sizes


def merged(cores, left: list[bytes], right: list[bytes], window: int):
    """For each number j of bytes to the left: (j, suffixes with such a string, its block, sizes of blocks, block of the right part of every suffix)."""
    import numpy as np

    depth = window - 1
    lefts, left_sizes = _columns(left, depth)
    rights, right_sizes = _columns(right, depth)
    start = np.cumsum(np.concatenate([[0], cores[1:] != cores[:-1]])).astype(np.int32)
    after = [start]
    for k in range(depth):
        after.append(refine(after[-1], rights[k]))
    before = start
    for j in range(depth + 1):
        if j:
            before = refine(before, lefts[j - 1])
        valid = np.flatnonzero((left_sizes >= j) & (right_sizes >= depth - j))
        if not len(valid):
            continue
        pairs = before[valid].astype(np.int64) * (int(after[depth - j].max()) + 1) + after[depth - j][valid]
        _, block, count = np.unique(pairs, return_inverse=True, return_counts=True)
        yield j, valid, block, count, after[depth - j]


def _resolve(length: int, window: int):
    """Covered stretches of surroundings sorted by core and right part: (doc_id, text_hash, start, end, code).

    ``code`` is null for a stretch that is covered. A core with very many surroundings is handled in parts, which
    follow one another in the order of the right part. A string can then be in two parts only if the block of its right
    part has the first or last suffix of a part; such strings are given with a hash, as many as differ, with
    ``start`` null where the string only stands for a covered one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        depth = window - 1
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.binary())])

        def close(rows, part):
            cores, docs, codes, places, opens, left, right = (list(c) for c in zip(*rows))
            low, high = np.full(len(rows), -1), np.full(len(rows), -1)
            spread = []
            is_open = np.array(opens)
            for j, valid, block, count, right_block in merged(np.array(cores), left, right, window):
                twice = valid[count[block] > 1]
                low[twice] = np.where(low[twice] < 0, j, low[twice])
                high[twice] = j
                if part:
                    _, one = np.unique(block, return_index=True)
                    one = one[np.isin(right_block[valid[one]], right_block[[0, -1]])]
                    for at, i in zip(one.tolist(), valid[one].tolist()):
                        alone = is_open[i] and count[block[at]] == 1
                        digest = hashlib.blake2b(b"%d/%d/" % (cores[i], j) + left[i][:j] + b"/" + right[i][:depth - j], digest_size=16).digest()
                        spread.append((docs[i], codes[i], places[i] - j if alone else None, places[i] - j + length if alone else None, digest))
            found = np.flatnonzero(is_open & (low >= 0)).tolist()
            out = [(docs[i], codes[i], places[i] - int(high[i]), places[i] - int(low[i]) + length, None) for i in found] + spread
            return out_batch(schema, [list(c) for c in zip(*out)]) if out else None

        rows, part = [], False
        for row in rows_of(batches):
            if len(rows) >= CHUNK_SUFFIXES:
                if row[0] != rows[-1][0]:
                    if (out := close(rows, part)) is not None:
                        yield out
                    rows, part = [], False
                elif rows[0][0] == row[0]:  # one core fills the chunk: go on with the next part of it
                    if (out := close(rows, True)) is not None:
                        yield out
                    rows, part = [], True
                else:  # keep the last core for the next chunk
                    at = next(i for i, r in enumerate(rows) if r[0] == row[0])
                    if (out := close(rows[:at], part)) is not None:
                        yield out
                    rows, part = rows[at:], False
            rows.append(row)
        if rows and (out := close(rows, part)) is not None:
            yield out

    return run


def _squeezed(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, data) with the texts compressed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("data", pa.binary())])
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, codes, data = batch.slice(at, 512).columns
                yield pa.RecordBatch.from_arrays([ids, codes, pa.array([pack(d) for d in data.to_pylist()], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, text_hash long, data binary")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, contents: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``contents`` also kept (binary) and spans (start, end).

    Strings are judged on the input and never cross documents. Null texts are empty; texts shorter than ``length`` stay whole. Rows
    that repeat id and text are occurrences of their own. Extra columns are ignored. ``window`` is from 2 to ``length`` less ``GRAM``.
    """
    if not 2 <= window <= length - GRAM:
        raise ValueError("window has to leave room for a core")
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    anchors = rows.select("doc_id", "data", "text_hash").mapInArrow(_anchor_rows(length, window), _ANCHORS)
    marks = scratch.keep(anchors.repartition("core").sortWithinPartitions("core", "reach").mapInArrow(_classify, _MARKS), "marks")

    wanted = marks.filter(F.col("kind") > _FULL).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "kind", "core")).alias("marks"))
    wanted = scratch.keep(wanted, "wanted")
    once = _squeezed(bit_filter(wanted.select("doc_id"), rows, "doc_id")).dropDuplicates(["doc_id", "text_hash"])
    around = once.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "data", "marks").mapInArrow(
        _surroundings(length, window), "core long, doc_id long, text_hash long, pos int, open boolean, left binary, right binary")
    found = around.repartition("core").sortWithinPartitions("core", "right").mapInArrow(_resolve(length, window), "doc_id long, text_hash long, start int, end int, code binary")
    found = scratch.keep(found, "found")
    parts = found.filter("code IS NOT NULL")
    across = parts.filter("start IS NOT NULL").join(parts.groupBy("code").count().filter("count > 1").select("code"), "code", "left_semi")
    stretches = found.filter("code IS NULL").unionByName(across).select("doc_id", "text_hash", F.col("start").alias("low"), F.col("end").alias("high"))
    whole = marks.filter(F.col("kind") == _FULL).select("doc_id", "text_hash", (F.col("pos") - (window - 1)).alias("low"), (F.col("pos") + length).alias("high"))
    cover = whole.unionByName(stretches).groupBy("doc_id", "text_hash").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if contents else "")

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        if contents:
            names += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        schema = pa.schema(names)
        unpack = zstandard.ZstdDecompressor().decompress
        out = [[] for _ in names]
        for doc_id, data, lows, highs in rows_of(batches, 64):
            data = unpack(data)
            spans = []
            if lows:
                low, high = np.maximum(np.array(lows), 0), np.minimum(np.array(highs), len(data))
                low, high = low[high - low >= length], high[high - low >= length]
                change = np.bincount(low, minlength=len(data) + 1) - np.bincount(high, minlength=len(data) + 1)
                inside = np.cumsum(change) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
            kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)]))
            row = [None if doc_id == _NULL_ID else doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
            if contents:
                row += [kept, [{"start": a, "end": b} for a, b in spans]]
            for column, value in zip(out, row):
                column.append(value)
            if len(out[0]) == 512:
                yield out_batch(schema, out)
                out = [[] for _ in names]
        yield out_batch(schema, out)

    return _squeezed(rows).join(cover, ["doc_id", "text_hash"], "left").select("doc_id", "data", "lows", "highs").mapInArrow(cut, kinds)
