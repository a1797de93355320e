"""Character n-gram linear classifier over naive Bayes log-count ratios.

Features of a text are its distinct n-grams of 3 to 6 characters of the lower-cased text, hashed into ``BUCKETS``.
A bucket's log-count ratio is ln((p + a) / |p|) - ln((q + a) / |q|), with p and q the training texts of label 1 and 0 that have it.
A logistic regression is fitted on the ratios of the buckets present, and its weights times the ratios are the
weights of the linear score. Only the text is an input of a score.

The fit uses at most ``SAMPLE`` labelled texts, picked by a hash of the id from all labelled rows, of which those with
label 1 at most ``POSITIVE``; the intercept is shifted back to the share of label 1 among all labelled rows.
``FEATURES`` buckets with the largest ratio times the root of their count are kept, of those that at least four texts have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import out_batch, rows_of

SIZES = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
SAMPLE = 6_000
POSITIVE = 2_000
FEATURES = 3_000
SMOOTHING = 2.0
RIDGE = 1.0
ROUNDS = 200
THRESHOLD = 0.3


class Grams:
    """Distinct buckets of a text."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None):
        np = self.np
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found = []
        hashed = codes
        for size in range(2, SIZES[-1] + 1):
            if len(codes) < size:
                break
            hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1:]
            if size in SIZES:
                mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
        if not found:
            return np.zeros(0, np.int32)
        buckets = np.concatenate(found)
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order  # a bucket keeps the place of one of its occurrences
        return buckets[self.last[buckets] == order]


@dataclass(frozen=True)
class Model:
    """``weights`` by bucket (float32) and the intercept."""

    weights: bytes
    intercept: float


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, sample: int, positive: int) -> tuple[DataFrame, float]:
    """Sampled (doc_id, label, text), one row per id, and the share of label 1 among all usable labels."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).head()
    order = F.xxhash64(F.col("doc_id"))
    ones = usable.filter("label = 1").orderBy(order, "doc_id").limit(positive)
    zeros = usable.filter("label = 0").orderBy(order, "doc_id").limit(sample - positive)
    chosen = ones.unionByName(zeros)  # at most ``sample`` rows of two numbers: the broadcast side
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows, counts["p"] / counts["n"] if counts["n"] else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, positive: int = POSITIVE) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of rows that aren't held out.

    Null texts count as empty, null labels are skipped, several labels of one id count as their largest. Of several texts of
    one id the smallest is learned from, so that the fit sees at most ``sample`` texts however often an id repeats. With no
    labels of one of the two kinds every score is the share of label 1.
    """
    import math

    import numpy as np

    rows, share = _training_rows(docs, labels, sample, positive)

    def buckets(batches):
        import pyarrow as pa

        grams = Grams()
        schema = pa.schema([("label", pa.int32()), ("buckets", pa.binary())])
        for label, text in rows_of(batches):
            yield out_batch(schema, [[label], [grams(text).tobytes()]])

    def counted(batches):
        import pyarrow as pa

        both = np.zeros((2, BUCKETS), np.int64)
        for label, found in rows_of(batches):
            both[label][np.frombuffer(found, np.int32)] += 1
        seen = np.flatnonzero(both.sum(0))
        schema = pa.schema([("bucket", pa.int32()), ("q", pa.int64()), ("p", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(both[0][seen]), pa.array(both[1][seen])], schema=schema)

    sampled = rows.select("label", "text").mapInArrow(buckets, "label int, buckets binary").persist()
    try:
        kinds = {r["label"]: r["count"] for r in sampled.groupBy("label").count().collect()}
        if len(kinds) < 2:
            p = min(max(share, 1e-6), 1 - 1e-6)
            return Model(np.zeros(BUCKETS, np.float32).tobytes(), math.log(p / (1 - p)))
        counts = sampled.mapInArrow(counted, "bucket int, q long, p long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        ratio = F.log((F.col("p") + SMOOTHING) / (kinds[1] + SMOOTHING)) - F.log((F.col("q") + SMOOTHING) / (kinds[0] + SMOOTHING))
        best = counts.filter("p + q >= 4").withColumn("ratio", ratio)
        best = best.orderBy((F.abs("ratio") * F.sqrt(F.col("p") + F.col("q"))).desc(), "bucket").limit(FEATURES).select("bucket", "ratio").toPandas()
        ratios = np.zeros(BUCKETS)
        ratios[best["bucket"].to_numpy()] = best["ratio"].to_numpy()

        def kept(batches):
            import pyarrow as pa

            schema = pa.schema([("label", pa.int32()), ("buckets", pa.binary())])
            for label, found in rows_of(batches):
                found = np.frombuffer(found, np.int32)
                yield out_batch(schema, [[label], [found[ratios[found] != 0].tobytes()]])

        few = sampled.mapInArrow(kept, "label int, buckets binary").collect()
    finally:
        sampled.unpersist()
    weights, intercept = _regression([(r[0], np.frombuffer(r[1], np.int32)) for r in few], ratios)
    sampled_odds = math.log(kinds[1] / kinds[0])
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model((weights * ratios).astype(np.float32).tobytes(), intercept - sampled_odds + math.log(share / (1 - share)))


def _regression(rows, ratios):
    """Logistic regression on the ratios of the present buckets: accelerated full-batch gradient descent."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    label = np.array([r[0] for r in rows], float)
    at = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    value = ratios[at]
    norm = np.sqrt(np.bincount(owner, value * value, len(rows)))
    weight = np.zeros(BUCKETS)
    ahead, bias, bias_ahead = weight.copy(), 0.0, 0.0
    step = 4.0 / max(float(np.mean(norm)) ** 2, 1.0)
    for turn in range(ROUNDS):
        score = np.bincount(owner, ahead[at] * value, len(rows)) + bias_ahead
        gap = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - label) / len(rows)
        slope = np.bincount(at, gap[owner] * value, BUCKETS) + RIDGE * ahead / len(rows)
        new, new_bias = ahead - step * slope * 4, bias_ahead - gap.sum()
        pull = turn / (turn + 3)
        ahead, bias_ahead = new + pull * (new - weight), new_bias + pull * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, float(bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` but one named like ``score_col``, and the score (0 to 1) of each whole text.

    Null texts count as empty; an empty text gets the score of the intercept.
    """
    import math

    import numpy as np
    import pyarrow as pa

    def one(batches):
        grams, weights = Grams(), np.frombuffer(model.weights, np.float32).astype(float)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = []
            for at in range(0, batch.num_rows, 256):
                for text in texts.slice(at, 256).to_pylist():
                    total = float(weights[grams(text)].sum()) + model.intercept
                    scores.append(1 / (1 + math.exp(-min(max(total, -40.0), 40.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], score_col])

    keep = [c for c in docs.columns if c != score_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text_to_score"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score_col, "double")
    return rows.mapInArrow(one, schema)
