"""Packs documents into training windows next to lexically similar documents.

The documents are tokenised once and lie in the shared folder. A BM25 index over token ids is kept in shards: a
shard is a stretch of the order by two min-hashes of the token set and the document id, so that alike documents tend
to share a shard and a large group of copies is spread over several. Document frequencies, count and mean length are those of the
whole corpus; their table has a row per id of the vocabulary at most. Within a shard a window of ``window`` ids is
filled greedily: the document that lies at its start is the seed, and its best unused neighbours follow. A document that
doesn't fit is cut, and its rest seeds the next window. What is left at the end of a shard goes into sequences whose
lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import Scratch, out_batch, rows_of
from pastward.llm.token_ids import END_ID, encoder

WINDOW = 4_096
#: A shard ends when it has so many ids or documents.
SHARD_IDS = 1 << 20
SHARD_DOCUMENTS = 1_024
K1, B = 1.2, 0.75
_TOKENISED = "doc_id long, n_tokens long, low long, next long, ids binary, frequencies binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its ids with the end id, and two min-hashes of the distinct ids.

    Each task adds a row with null ``ids`` and, in ``frequencies``, the number of its documents that have each id.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = encoder(vocabulary)
        width = "<u2" if known.size <= 65_536 else "<u4"
        frequencies, place = np.zeros(known.size, "<u4"), np.zeros(known.size, np.int32)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("next", pa.int64()), ("ids", pa.binary()), ("frequencies", pa.binary())])
        first = (np.arange(known.size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        first = ((first ^ (first >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(2)
        second = ((first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(2)
        first, second = first.astype(np.int64), second.astype(np.int64)
        end, out = struct.pack("<I", END_ID), [[] for _ in range(5)]
        for doc_id, text in rows_of(batches):
            ids = np.frombuffer(known.packed(text) + end, "<u4")
            order = np.arange(len(ids), dtype=np.int32)
            place[ids] = order
            distinct = ids[place[ids] == order]
            frequencies[distinct] += 1
            for column, value in zip(out, (doc_id, len(ids), first[distinct].min(), second[distinct].min(), ids.astype(width).tobytes())):
                column.append(value)
            if len(out[0]) == 512:
                yield out_batch(schema, [*out, [None] * 512])
                out = [[] for _ in range(5)]
        yield out_batch(schema, [*(c + [None] for c in out), [None] * len(out[0]) + [frequencies.tobytes()]])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _TOKENISED)


def corpus_statistics(rows: DataFrame, size: int):
    """Inverse document frequency by id and the mean length, over all documents."""
    import numpy as np
    import pyarrow as pa

    def spread(batches):
        schema = pa.schema([("id", pa.int32()), ("documents", pa.int64())])
        for (data,) in rows_of(batches, 16):
            counts = np.frombuffer(data, "<u4")
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen].astype(np.int64))], schema=schema)

    counts = rows.filter("frequencies IS NOT NULL").select("frequencies").mapInArrow(spread, "id int, documents long")
    counts = counts.groupBy("id").agg(F.sum("documents").alias("documents")).toPandas()  # a row per id of the vocabulary at most
    total = rows.filter("frequencies IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.avg("n_tokens"), F.lit(1.0)).alias("mean")).head()
    documents = np.zeros(size)
    documents[counts["id"].to_numpy()] = counts["documents"].to_numpy()
    return np.log1p((total["n"] - documents + 0.5) / (documents + 0.5)).astype(np.float32), float(total["mean"])


class Shard:
    """A BM25 index of some documents: a row of weights for each id that two of them share."""

    def __init__(self, arrays, idf, mean: float):
        import numpy as np

        self.np = np
        self.lengths = np.array([len(a) for a in arrays])
        found = [np.unique(a, return_counts=True) for a in arrays]
        ids = np.concatenate([f[0] for f in found])
        counts = np.concatenate([f[1] for f in found]).astype(np.float32)
        owner = np.repeat(np.arange(len(arrays)), [len(f[0]) for f in found])
        useful = np.bincount(ids, minlength=len(idf)) > 1
        row = np.cumsum(useful) - 1
        keep = useful[ids]
        ids, counts, owner = ids[keep], counts[keep], owner[keep]
        scale = K1 * (1 - B + B * self.lengths[owner] / mean)
        self.weights = np.zeros((int(useful.sum()), len(arrays)), np.float32)
        self.weights[row[ids], owner] = idf[ids] * counts * (K1 + 1) / (counts + scale)
        ends = np.cumsum(np.bincount(owner, minlength=len(arrays)))
        self.terms = np.split(row[ids], ends[:-1])

    def order(self, window: int) -> list[int]:
        """Documents in packing order."""
        np = self.np
        free = np.ones(len(self.lengths), bool)
        out, at, seed, ranked = [], 0, None, iter(())
        for _ in range(len(self.lengths)):
            if seed is None or at >= window:
                if seed is None:
                    nearest = 0
                else:
                    # The document that reached over the end of the window seeds the next one.
                    at %= window
                    seed = out[-1]
                    ranked = self._neighbours(seed, free)
                    nearest = next(ranked)
            else:
                nearest = next(ranked)
            free[nearest] = False
            out.append(nearest)
            at += int(self.lengths[nearest])
            if seed is None:
                seed = nearest
                if at < window:
                    ranked = self._neighbours(seed, free)
        return out

    def _neighbours(self, seed: int, free):
        """Unused documents, best first; equal scores in the order of the shard."""
        np = self.np
        scores = self.weights[self.terms[seed]].sum(0)
        open_ = np.flatnonzero(free)
        return iter(open_[np.argsort(-scores[open_], kind="stable")].tolist())


def cuts(total: int, window: int):
    """Starts of the sequences over ``total`` ids: whole windows, then powers of two."""
    import numpy as np

    starts = list(range(0, total - total % window, window))
    at, rest = total - total % window, total % window
    while rest:
        starts.append(at)
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
    return np.array(starts)


def _pack_shard(ids: list, arrays: list, idf, mean: float, window: int, base: int):
    """Columns of the pieces and the number of sequences."""
    import numpy as np

    order = Shard(arrays, idf, mean).order(window)
    stream = np.concatenate([arrays[k] for k in order]).astype("<u4")
    lengths = np.array([len(arrays[k]) for k in order])
    doc_starts = np.cumsum(lengths) - lengths
    sequences = cuts(len(stream), window)
    points = np.union1d(doc_starts, sequences)
    ends = np.append(points[1:], len(stream))
    doc = np.searchsorted(doc_starts, points, "right") - 1
    sequence = np.searchsorted(sequences, points, "right") - 1
    data = memoryview(stream.tobytes())
    crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(points.tolist(), ends.tolist())]
    return [[ids[order[d]] for d in doc.tolist()], points - doc_starts[doc], ends - points, crcs, lengths[doc], base + sequence, points - sequences[sequence]], len(sequences)


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document of its own, also with a null or repeated id; a null text is empty and has the
    end id only. Extra columns are ignored. No rows give no pieces. ``window`` is a power of two.
    """
    import numpy as np

    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.keep(tokenised(docs, vocabulary, id_col, text_col), "tokenised")
    size = encoder(vocabulary).size
    idf, mean = corpus_statistics(rows, size)
    width = "<u2" if size <= 65_536 else "<u4"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])
        number = TaskContext.get().partitionId() << 40
        ids, arrays, held = [], [], 0
        for doc_id, data in rows_of(batches, 128):
            ids.append(doc_id)
            arrays.append(np.frombuffer(data, width))
            held += len(arrays[-1])
            if held >= SHARD_IDS or len(ids) >= SHARD_DOCUMENTS:
                columns, used = _pack_shard(ids, arrays, idf, mean, window, number)
                yield out_batch(schema, columns)
                number, ids, arrays, held = number + used, [], [], 0
        if ids:
            yield out_batch(schema, _pack_shard(ids, arrays, idf, mean, window, number)[0])

    order = [F.col("low"), F.col("next"), F.col("doc_id").asc_nulls_first()]
    shards = rows.filter("frequencies IS NULL").select("low", "next", "doc_id", "ids").repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    return shards.select("doc_id", "ids").mapInArrow(run, _PIECES)
