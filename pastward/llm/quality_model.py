"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its distinct lower-cased words, hashed into ``BUCKETS`` and weighted by the root of their
number to length one, and one bucket for the bin of each structure statistic and of the metadata (the ``n_chars`` column, if there is one).
Its score is the logistic function of

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the pairs cost one pass over the buckets present: sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).
Neither ids, labels, lang nor source are inputs of a score.

The fit uses at most ``SAMPLE`` labelled documents, picked by a hash of the id from all labelled rows that aren't held out. What
it holds on the driver is bounded by ``SAMPLE`` documents of at most ``BUCKETS`` numbers each; the model is ``BUCKETS * (RANK + 1)`` numbers of four bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import SPACES, out_batch, rows_of
from pastward.llm.words import hasher

BITS = 16
BUCKETS = 1 << BITS
RANK = 6
SAMPLE = 6_000
EPOCHS = 10
PARTS = 8
STEP = 0.05
RIDGE = 2e-4
THRESHOLD = 0.3
#: Buckets at the low end that hold the bins of statistics, ``BINS`` each; words use the rest.
BINS = 32
STATISTICS = (
    "words", "word_length", "upper", "digits", "points", "symbols", "other_bytes", "distinct_words", "commonest_word", "same_neighbours",
    "words_in_line", "distinct_lines", "n_chars", "n_chars_off",
)
RESERVED = BINS * len(STATISTICS)
#: Characters of running text; other ASCII characters that are neither letters, digits nor spaces count as symbols.
POINTS = ".,;:!?'\"()-"


class Features:
    """Buckets (int32, ascending) and values (float32) of a text and its ``n_chars``."""

    def __init__(self):
        import numpy as np

        self.np = np
        kinds = np.zeros((256, 6))
        for byte in range(256):
            char, ascii_ = chr(byte), byte < 128
            symbol = 32 < byte < 127 and not char.isalnum()
            kinds[byte] = (ascii_ and char.isupper(), ascii_ and char.isdigit(), char in POINTS, symbol and char not in POINTS, not ascii_, char not in SPACES)
        self.kinds = kinds

    @staticmethod
    def _share_bin(part: float, whole: float) -> int:
        return min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole else 0

    @staticmethod
    def _size_bin(size: float) -> int:
        return min(BINS - 1, int(1.5 * math.log2(1 + max(size, 0))))

    def bins(self, text: str, n_chars: int | None, words, counts) -> list[int]:
        """A bin for each of ``STATISTICS``, from hashes of the words in order and the numbers of the distinct ones."""
        np = self.np
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        upper, digits, points, symbols, other, inked = np.bincount(data, minlength=256) @ self.kinds
        same, words, lines, known = int((words[1:] == words[:-1]).sum()), len(words), text.split("\n"), n_chars is not None
        return [
            self._size_bin(words), min(BINS - 1, int(2 * inked / words)) if words else 0,
            self._share_bin(upper, inked), self._share_bin(digits, inked), self._share_bin(points, inked),
            self._share_bin(symbols, inked), self._share_bin(other, inked),
            self._share_bin(len(counts), words), self._share_bin(int(counts.max()) if words else 0, words), self._share_bin(same, words),
            self._size_bin(words / len(lines)), self._share_bin(len(set(lines)), len(lines)),
            self._size_bin(n_chars) if known else 0, int(known and n_chars != len(text)),
        ]

    def __call__(self, text: str | None, n_chars: int | None = None):
        np = self.np
        text = text or ""
        words = hasher()(text)
        hashes, counts = np.unique(words, return_counts=True)
        buckets = (hashes >> np.uint64(64 - 2 * BITS)) % np.uint64(BUCKETS - RESERVED) + np.uint64(RESERVED)
        found, at = np.unique(buckets, return_inverse=True)
        weight = np.sqrt(np.bincount(at, counts, len(found))) if len(found) else np.zeros(0)
        norm = math.sqrt(float((weight * weight).sum())) or 1.0
        own = BINS * np.arange(len(STATISTICS)) + self.bins(text, n_chars, words, counts)
        return np.concatenate([own, found]).astype(np.int32), np.concatenate([np.ones(len(own)), weight / norm]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``weights`` (float32 by bucket), ``factors`` (float32, bucket by rank) and the bias."""

    weights: bytes
    factors: bytes
    bias: float

    def arrays(self):
        import numpy as np

        return np.frombuffer(self.weights, np.float32), np.frombuffer(self.factors, np.float32).reshape(BUCKETS, RANK)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def margin(weights, factors, bias: float, buckets, values) -> float:
    """The score before the logistic function, in time linear in the buckets present."""
    present = factors[buckets] * values[:, None]
    sums = present.sum(0, dtype=float)
    return bias + float(weights[buckets] @ values) + 0.5 * float((sums * sums).sum() - (present * present).sum(dtype=float))


def _chances(total: float) -> float:
    return 1 / (1 + math.exp(-min(max(total, -40.0), 40.0)))


def _training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows (label, text, n_chars), one for each id."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    found = docs.select("doc_id", F.struct(F.xxhash64("text").alias("order"), "text", size.alias("n_chars")).alias("doc")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("doc").alias("doc")).select("label", "doc.text", "doc.n_chars")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, quality) of rows that aren't held out.

    Null texts count as empty, null labels are skipped, several labels of one id count as their largest, of several documents with one
    id one is taken by a hash of the text. With labels of one kind every score is that kind's share, kept off 0 and 1; without any it is 1/2.
    """
    import numpy as np

    def described(batches):
        import pyarrow as pa

        features = Features()
        schema = pa.schema([("label", pa.int32()), ("buckets", pa.binary()), ("values", pa.binary())])
        for label, text, n_chars in rows_of(batches):
            buckets, values = features(text, n_chars)
            yield out_batch(schema, [[label], [buckets.tobytes()], [values.tobytes()]])

    rows = _training_rows(docs, labels, sample).mapInArrow(described, "label int, buckets binary, values binary").collect()
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in rows)
    kinds = {r[0] for r in rows}
    if len(kinds) < 2:
        bias = {frozenset(): 0.0, frozenset([1]): 6.0, frozenset([0]): -6.0}[frozenset(kinds)]
        return Model(np.zeros(BUCKETS, np.float32).tobytes(), np.zeros((BUCKETS, RANK), np.float32).tobytes(), bias)
    return _machine(np.array([r[0] for r in rows], float), [np.frombuffer(r[1], np.int32) for r in rows], [np.frombuffer(r[2], np.float32) for r in rows])


def _machine(label, buckets, values) -> Model:
    """Weights and factors that make the logistic loss plus a ridge penalty small: Adam over ``PARTS`` parts of the rows in turn."""
    import numpy as np

    seen = np.unique(np.concatenate(buckets))
    parts = []
    for k in range(min(PARTS, len(label))):  # rows come in the order of labels, so each part has its share of both
        sizes = np.array([len(b) for b in buckets[k::PARTS]])
        at = np.searchsorted(seen, np.concatenate(buckets[k::PARTS]))
        by_bucket = np.argsort(at, kind="stable")
        own, first = np.unique(at[by_bucket], return_index=True)
        parts.append((label[k::PARTS], np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes), at, np.concatenate(values[k::PARTS]), by_bucket, own, first))
    share = label.mean()
    bias = math.log(share / (1 - share))
    # row 0 has the linear weights, the others the factors; they start small and unlike, else their gradient is zero
    theta = np.random.Generator(np.random.PCG64(13)).normal(0, 0.05, (RANK + 1, len(seen))).astype(np.float32)
    theta[0] = 0
    mean, square, mean_b, square_b, turn = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(EPOCHS):
        for truth, starts, owner, at, x, by_bucket, own, first in parts:
            turn += 1
            present = theta[:, at] * x
            sums = np.add.reduceat(present, starts, 1)
            squares = np.add.reduceat((present[1:] ** 2).sum(0), starts)
            total = bias + sums[0] + 0.5 * ((sums[1:] ** 2).sum(0) - squares)
            gap = ((1 / (1 + np.exp(-np.clip(total, -40, 40))) - truth) / len(truth)).astype(np.float32)
            pull = x * gap[owner]
            pulls = np.concatenate([pull[None], (sums[1:, owner] - present[1:]) * pull])
            slope = np.float32(RIDGE) * theta
            slope[:, own] += np.add.reduceat(pulls[:, by_bucket], first, 1)
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
            theta = theta - STEP * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.99 ** turn)) + np.float32(1e-5))
            pull_b = float(gap.sum())
            mean_b, square_b = 0.9 * mean_b + 0.1 * pull_b, 0.99 * square_b + 0.01 * pull_b**2
            bias -= STEP * (mean_b / (1 - 0.9 ** turn)) / (math.sqrt(square_b / (1 - 0.99 ** turn)) + 1e-5)
    weights, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32)
    weights[seen], factors[seen] = theta[0], theta[1:].T
    return Model(weights.tobytes(), factors.tobytes(), float(bias))


def scored(docs: DataFrame, model: Model, text_col: str = "text", size_col: str = "n_chars", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` but one named like ``score_col``, and the score (0 to 1) of each whole text.

    Null texts count as empty, and an empty text is scored by the bins of its statistics. A missing ``size_col`` and null in it are
    a bin of their own. Repeated rows get equal scores; an empty table gives an empty table. A text is held as a whole by one task, whatever its length.
    """
    import pyarrow as pa

    def one(batches):
        features, (weights, factors) = Features(), model.arrays()
        for batch in batches:
            texts, sizes = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            scores = []
            for at in range(0, batch.num_rows, 256):
                for text, n_chars in zip(texts.slice(at, 256).to_pylist(), sizes.slice(at, 256).to_pylist(), strict=True):
                    scores.append(_chances(margin(weights, factors, model.bias, *features(text, n_chars))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-2], score_col])

    keep = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
    size = F.try_to_number(F.col(size_col).cast("string"), F.lit("999999999999999999")).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    if size_col in docs.columns and docs.schema[size_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        size = F.col(size_col).cast("long")
    rows = docs.select(*keep, F.col(text_col).alias("_text_to_score"), size.alias("_size_to_score"))
    return rows.mapInArrow(one, docs.select(*keep).schema.add(score_col, "double"))
