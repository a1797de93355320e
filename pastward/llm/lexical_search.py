"""Exact top-k search by BM25 over an inverted index in shards, with block-max pruning.

Terms are words, lower-cased in A-Z. Every task of ``index`` turns its documents into segments: posting lists by term
in the shared folder. ``search`` deals the segments to ``GROUPS`` groups. A group gets the whole query set once, in blocks of
``QUERY_BLOCK`` queries, looks it up in one shard of about ``SHARD_DOCUMENTS`` after the other, and returns the best of all its
shards; so what is shuffled and what is merged grow with the documents and with the queries, not with their product.
Document frequencies, the number of documents and their mean length are those of the whole corpus, so the merge is exact.

Inside a shard a query's terms are split into rare ones, whose lists are short, and frequent ones. A document's score
is at most its score from the rare terms plus, for its block of ``BLOCK`` documents, the greatest contributions of the frequent terms.
Documents whose bound is below the k-th best score of the group's earlier shards are left out. Blocks hold documents with the same
commonest word and similar lengths, which keeps the bounds low. For the others the frequent terms of all queries of a block are summed by one
product of single precision, and exactly only for those that its error leaves among the best.

A contribution is rounded to a millionth; sums of such are exact, whatever their order, and equal texts tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastward.llm.shared import Scratch, out_batch, rows_of
from pastward.llm.words import hasher

K1, B = 1.2, 0.75
TOP = 10
SEGMENT_DOCUMENTS = 4_096
SEGMENT_POSTINGS = 2 << 20
SHARD_DOCUMENTS = 4_096
#: Tasks that look up queries; fixed, since each of them gets all queries and returns ``k`` rows for each.
GROUPS = 24
#: Bytes of packed queries that such a task holds in memory; beyond, they lie in a temporary file.
HELD_QUERIES = 32 << 20
QUERY_BLOCK = 512
BLOCK = 64
#: A term is frequent in a shard if more than one in so many documents has it.
FREQUENT = 16
UNIT = 1e6
_SEGMENT = "segment long, documents long, words long, ids binary, lengths binary, terms binary, counts binary, postings binary"


def _segment(number: int, ids: list, found: list, lengths: list) -> list:
    """Columns of a segment: documents ordered by commonest word and length, postings by term."""
    import numpy as np

    commonest = np.array([t[np.argmax(c)] if len(t) else 0 for t, c in found], np.uint64)
    order = np.lexsort((np.array(lengths), commonest))
    sizes = np.array([len(found[k][0]) for k in order])
    terms = np.concatenate([found[k][0] for k in order] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([found[k][1] for k in order] or [np.zeros(0, np.uint32)]).astype("<u4")
    documents = np.repeat(np.arange(len(order), dtype="<u4"), sizes)
    by_term = np.argsort(terms, kind="stable")
    distinct, frequency = np.unique(terms, return_counts=True)
    known = [ids[k] for k in order]
    return [
        number, len(ids), int(sum(lengths)), np.array([i or 0 for i in known], "<i8").tobytes() + bytes(i is None for i in known), np.array(lengths, "<u4")[order].tobytes(),
        distinct.astype("<u8").tobytes(), frequency.astype("<u4").tobytes(), documents[by_term].tobytes() + counts[by_term].tobytes(),
    ]


def index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all rows of ``docs``, stored. Nothing is shuffled. Null texts have no terms."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        schema = pa.schema([(c.split()[0], k) for c, k in zip(_SEGMENT.split(", "), kinds)])
        number, hashes = TaskContext.get().partitionId() << 24, hasher()
        ids, found, lengths, held = [], [], [], 0
        for doc_id, text in rows_of(batches):
            words = hashes(text)
            ids.append(doc_id)
            terms, counts = np.unique(words, return_counts=True)
            found.append((terms, counts.astype(np.uint32)))
            lengths.append(len(words))
            held += len(found[-1][0])
            if len(ids) >= SEGMENT_DOCUMENTS or held >= SEGMENT_POSTINGS:
                yield out_batch(schema, [[v] for v in _segment(number, ids, found, lengths)])
                number, ids, found, lengths, held = number + 1, [], [], [], 0
        if ids:
            yield out_batch(schema, [[v] for v in _segment(number, ids, found, lengths)])

    return scratch.keep(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _SEGMENT), "segments")


def _query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = hasher()
        schema = pa.schema([("query_id", pa.int64()), ("term", pa.int64())])
        for query_id, text in rows_of(batches):
            terms = np.unique(hashes(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(terms), pa.int64()), pa.array(terms)], schema=schema)

    return queries.mapInArrow(run, "query_id long, term long").distinct()


def _frequencies(segments: DataFrame) -> DataFrame:
    """(term, documents) of each segment."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("term", pa.int64()), ("documents", pa.int64())])
        for terms, counts in rows_of(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], schema=schema)

    return segments.select("terms", "counts").mapInArrow(run, "term long, documents long")


def _query_blocks(terms: DataFrame, blocks: int) -> DataFrame:
    """(block, data): queries packed together. ``terms``: query_id, term, documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        import zstandard

        schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])
        pack = zstandard.ZstdCompressor(level=3).compress

        def close(block, parts):
            ids, hashes, documents = (np.concatenate(p) for p in zip(*parts))
            distinct, first, where = np.unique(hashes.view(np.uint64), return_index=True, return_inverse=True)
            queries, starts = np.unique(ids, return_index=True)
            head = np.array([len(distinct), len(queries), len(ids)], "<i8")
            data = [head, _steps(distinct.astype("<u8")), documents[first].astype("<i8"), queries.astype("<i8"), np.append(starts, len(ids)).astype("<i8"), _steps(where.astype("<u4"))]
            return out_batch(schema, [[block], [pack(b"".join(d.tobytes() for d in data))]])

        current, parts = None, []
        for batch in batches:
            block, ids, hashes, documents = (c.to_numpy() for c in batch.columns)
            for at, end in zip(*_runs(block)):
                if parts and block[at] != current:
                    yield close(current, parts)
                    parts = []
                current = int(block[at])
                parts.append((ids[at:end], hashes[at:end], documents[at:end]))
        if parts:
            yield close(current, parts)

    rows = terms.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "term", "documents")
    return rows.repartition("block").sortWithinPartitions("block", "query_id", "term").mapInArrow(run, "block int, data binary")


def _runs(values):
    import numpy as np

    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return [0, *edges.tolist()] if len(values) else [], [*edges.tolist(), len(values)] if len(values) else []


def _steps(values):
    """Differences to the value before, which compress better; sums give the values back, whatever wraps around."""
    import numpy as np

    return np.diff(values, prepend=values.dtype.type(0))


def _unpacked_block(data: bytes):
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    terms, queries, size = np.frombuffer(data, "<i8", 3)
    out, at = [], 24
    for kind, count in (("<u8", terms), ("<i8", terms), ("<i8", queries), ("<i8", queries + 1), ("<u4", size)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return np.cumsum(out[0], dtype=np.uint64), *out[1:4], np.cumsum(out[4], dtype=np.uint32)


class Shard:
    """Posting lists of some segments."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        known, nulls, lengths, terms, sizes, documents, counts, base = [], [], [], [], [], [], [], 0
        for ids, length, term, frequency, postings in rows:
            size = len(length) // 4
            known.append(np.frombuffer(ids, "<i8", size))
            nulls.append(np.frombuffer(ids, bool, size, 8 * size))
            lengths.append(np.frombuffer(length, "<u4"))
            terms.append(np.frombuffer(term, "<u8"))
            sizes.append(np.frombuffer(frequency, "<u4").astype(np.int32))
            both = np.frombuffer(postings, "<u4").reshape(2, -1)
            documents.append(both[0].view(np.int32) + np.int32(base))
            counts.append(both[1])
            base += size
        self.ids, self.nulls = np.concatenate(known), np.concatenate(nulls)
        self.lengths = np.concatenate(lengths).astype(float)
        if len(rows) == 1:  # its postings are in order
            self.terms, self.documents, self.counts = terms[0], documents[0], counts[0]
            self.ends = np.cumsum(sizes[0])
            self.starts = self.ends - sizes[0]
            return
        lists, lengths = np.concatenate(terms), np.concatenate(sizes)
        order = np.argsort(lists, kind="stable")
        at = _ranges((np.cumsum(lengths) - lengths)[order], lengths[order])
        self.documents, self.counts = np.concatenate(documents)[at], np.concatenate(counts)[at]
        self.terms, first = np.unique(lists[order], return_index=True)
        self.ends = np.cumsum(lengths[order])[np.append(first[1:], len(order)) - 1]
        self.starts = np.append(0, self.ends[:-1])

    def _values(self, at, idf, mean: float):
        """Contributions, in units, of the postings at ``at``; a part at a time, to keep what is held small."""
        import numpy as np

        out = np.empty(len(at), np.int32)
        for low in range(0, len(at), 1 << 17):
            part = at[low:low + (1 << 17)]
            counts = self.counts[part].astype(float)
            norm = K1 * (1 - B + B * self.lengths[self.documents[part]] / mean)
            out[low:low + len(part)] = np.rint(UNIT * (idf[low:low + len(part)] * (counts * (K1 + 1) / (counts + norm))))
        return out

    def best(self, block: bytes, total: int, mean: float, k: int, held: tuple | None = None) -> tuple:
        """Query ids of a block and, a row for each, the scores in units, ids and null marks of its best ``k`` documents.

        ``held``: the same from other shards, whose documents take part. Places beyond the last document score 0.
        """
        import numpy as np

        terms, frequency, queries, bounds, where = _unpacked_block(block)
        size = len(self.ids)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1) if len(self.terms) else np.zeros(len(terms), int)
        here = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        begin, end = np.where(here, self.starts[place], 0), np.where(here, self.ends[place], 0)
        lengths = end - begin
        at = _ranges(begin, lengths)
        idf = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5))
        value = self._values(at, np.repeat(idf, lengths), mean)
        documents = self.documents[at]
        del at
        offset = np.cumsum(lengths) - lengths
        frequent = lengths * FREQUENT > size
        row = np.cumsum(frequent) - 1
        blocks = -(-size // BLOCK)
        dense = np.zeros((int(frequent.sum()), blocks * BLOCK), np.int32)
        for term in np.flatnonzero(frequent).tolist():
            part = slice(offset[term], offset[term] + lengths[term])
            dense[row[term], documents[part]] = value[part]
        highest = dense.reshape(len(dense), blocks, BLOCK).max(2) if len(dense) else np.zeros((0, blocks), np.int32)
        # In the types that sums are made in, converted once for all queries.
        documents, value = documents.astype(np.int64), value.astype(float)
        asked = np.zeros((len(queries), len(dense)), np.float32)
        asked[np.repeat(np.arange(len(queries)), np.diff(bounds))[frequent[where]], row[where[frequent[where]]]] = 1
        # Products of all queries at once. Those of single precision are off by less than ``slack``; only who may be among the best is summed exactly.
        most, near = asked.astype(float) @ highest, asked @ dense.astype(np.float32)
        slack = asked.sum(1) * near.max(1, initial=0) * 2.0 ** -22

        scored, ids, nulls = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), bool)
        for q in range(len(queries)):
            own = where[bounds[q]:bounds[q + 1]]
            rare, common = own[~frequent[own]], row[own[frequent[own]]]
            at = _ranges(offset[rare], lengths[rare])
            scores = np.bincount(documents[at], value[at], blocks * BLOCK)
            known = float(held[1][q, k - 1]) if held else 0.0
            bound = (scores.reshape(blocks, BLOCK) + most[q][:, None]).ravel()[:size]
            possible = np.flatnonzero(bound >= max(known, 1.0))
            about = scores[possible] + near[q, possible]
            least = known - slack[q]
            if len(about) > k:
                least = max(least, np.partition(about, len(about) - k)[len(about) - k] - 2 * slack[q])
            kept = possible[about >= least]
            exact = scores[kept] + _summed(dense, common, kept)
            kept, exact = kept[exact > 0], exact[exact > 0]
            best = np.lexsort((self.ids[kept], self.nulls[kept], -exact))[:k]
            scored[q, :len(best)] = exact[best]
            ids[q, :len(best)], nulls[q, :len(best)] = self.ids[kept[best]], self.nulls[kept[best]]
        if held:
            scored, ids, nulls = (np.hstack(pair) for pair in zip(held[1:], (scored, ids, nulls)))
            order = np.lexsort((ids, nulls, -scored))[:, :k]
            scored, ids, nulls = (np.take_along_axis(v, order, 1) for v in (scored, ids, nulls))
        return queries, scored, ids, nulls


def _summed(dense, terms, documents):
    """Units of some documents from some frequent terms."""
    return dense[terms[:, None], documents].sum(0)


class Group:
    """The query blocks of a group of segments, and the best that its shards have so far; holds the lists of one shard."""

    def __init__(self, total: int, mean: float, k: int, shard_documents: int, held_queries: int):
        import tempfile

        self.corpus, self.shard_documents = (total, mean, k), shard_documents
        self.queries, self.sizes, self.best = tempfile.SpooledTemporaryFile(held_queries), [], []
        self.rows, self.documents = [], 0

    def ask(self, block: bytes) -> None:
        self.queries.write(block)
        self.sizes.append(len(block))
        self.best.append(None)

    def add(self, row: tuple) -> None:
        """A segment: ids, lengths, terms, counts, postings."""
        size = len(row[1]) // 4
        if self.documents + size > self.shard_documents:
            self._look_up()
        self.rows.append(row)
        self.documents += size

    def _look_up(self) -> None:
        if not self.rows:
            return
        shard, self.rows, self.documents = Shard(self.rows), [], 0
        self.queries.seek(0)
        for number, size in enumerate(self.sizes):
            self.best[number] = shard.best(self.queries.read(size), *self.corpus, self.best[number])

    def close(self):
        """Batches of (query_id, doc_id, units): the best of the whole group, one batch for each block."""
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("units", pa.int64())])
        self._look_up()
        self.queries.close()
        for queries, scored, ids, nulls in filter(None, self.best):
            found = scored > 0
            columns = pa.array(np.repeat(queries, found.sum(1))), pa.array(ids[found], mask=nulls[found]), pa.array(scored[found])
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)


def _ranges(begin, lengths):
    """All positions of the ranges that start at ``begin``, one range after the other."""
    import numpy as np

    out = np.repeat((begin - np.cumsum(lengths) + lengths).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _best_of_groups(segments: DataFrame, packed: DataFrame, scratch: Scratch, count: int, total: int, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, units): the best ``k`` of each query in each group of the ``count`` segments."""
    groups = max(1, min(GROUPS, count))
    # A row per segment, so a row per task of the indexer: few enough for one window.
    largest_first = Window.orderBy(F.col("words").desc(), "segment")
    placed = segments.select("segment", "words").withColumn("group", F.pmod(F.row_number().over(largest_first), F.lit(groups)))
    placed = scratch.keep(placed.select("segment", "group"), "groups")

    def run(batches):
        current, group = None, None
        for number, is_segment, *lists, data in rows_of(batches, 1):
            if number != current:
                if group:
                    yield from group.close()
                current, group = number, Group(total, mean, k, SHARD_DOCUMENTS, HELD_QUERIES)
            if is_segment:
                group.add(tuple(lists))
            else:
                group.ask(data)
        if group:
            yield from group.close()

    columns, empty = ["ids", "lengths", "terms", "counts", "postings"], F.lit(None).cast("binary")
    lists = segments.join(placed, "segment").select("group", F.lit(True).alias("is_segment"), "segment", *columns, empty.alias("data"))
    # The stated query set meets every group, a block at a time, before the group's segments.
    many = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = many.select("group", F.lit(False).alias("is_segment"), F.col("block").cast("long").alias("segment"), *[empty.alias(c) for c in columns], "data")
    pairs = lists.unionAll(asked).repartitionById(groups, "group").sortWithinPartitions("group", "is_segment", "segment").drop("segment")
    return pairs.mapInArrow(run, "query_id long, doc_id long, units long")


def search(segments: DataFrame, queries: DataFrame, scratch: Scratch, k: int = TOP) -> DataFrame:
    """(query_id, rank from 1, doc_id, score) of the best ``k`` documents of each query.

    ``queries``: query_id, text; null ids are skipped, rows that repeat an id ask as one query, a query without terms
    finds nothing. A document is found if it has a term of the query. Equal scores stand in the order of the document
    id, a null id last; rows that repeat an id are documents of their own.
    """
    totals = segments.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"), F.count("segment").alias("segments")).head()
    total, mean = totals["documents"] or 0, (totals["words"] or 0) / (totals["documents"] or 1) or 1.0
    terms = _query_terms(queries.filter("query_id IS NOT NULL").select(F.col("query_id").cast("long"), "text"))
    terms = scratch.keep(terms, "query_terms")
    frequency = _frequencies(segments).groupBy("term").agg(F.sum("documents").alias("documents"))
    blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERY_BLOCK))
    packed = scratch.keep(_query_blocks(terms.join(frequency, "term"), blocks), "query_blocks")
    found = _best_of_groups(segments, packed, scratch, totals["segments"], total, mean, k)
    best = Window.partitionBy("query_id").orderBy(F.col("units").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", (F.col("units") / UNIT).alias("score"))


#: The result for DuckDB, over the view ``documents``: queries are the documents whose id is divisible by 100.
SQL = rf"""
WITH words AS (
 SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM words) / count(*) AS mean FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
 SELECT q.doc_id AS query_id, d.doc_id, sum(CAST(round({UNIT} * (ln(1 + (n - df + 0.5) / (df + 0.5)) * (d.tf * ({K1} + 1) / (d.tf + {K1} * (1 - {B} + {B} * dl / mean))))) AS BIGINT)) AS units
 FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id CROSS JOIN n WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank, doc_id, CAST(units / {UNIT} AS DOUBLE) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM scores WHERE units > 0) WHERE rank <= {TOP}
"""
