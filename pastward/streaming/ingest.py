"""Snapshot ingest as a stream that runs over what has arrived and stops.

The state is a base and the deltas since then. A micro-batch writes its own rows only, the newest (or first) one of a key,
partitioned by a hash of the key, and commits them with a marker; readers merge base and deltas by one aggregate per key.
After a number of deltas a compaction writes a new base. What a batch costs depends on the batch, not on the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pastward.sources import versions

BUCKETS, COMPACT_AFTER = 16, 8
_BUCKET, _BATCH = "_bucket", "_batch"


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _one_per_key(rows: DataFrame, keys: list[str], order: list[str], mode: str) -> DataFrame:
    """The row that holds for each key: the last one for upserts, the first one for inserts. Partial results are merged before the shuffle."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    pick = F.max_by if mode == "upsert" else F.min_by
    return rows.groupBy(*keys).agg(pick(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def write_batch(batch: DataFrame, number: int, state: str, keys: list[str], order: list[str], mode: str = "upsert", buckets: int = BUCKETS) -> bool:
    """Write and commit the delta of a batch; a batch that is committed already is left as it is."""
    rows = _one_per_key(batch, keys, order, mode).select(*batch.columns)
    rows = rows.withColumns({_BUCKET: bucket_of(keys, buckets), _BATCH: F.lit(number).cast("long")})
    # A task holds few buckets, so that a batch makes few files.
    return versions.write(rows.repartition(buckets, _BUCKET), state, number, "delta", (_BUCKET,))


def _stored(spark: SparkSession, state: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of the newest base and of the deltas after it."""
    base = versions.newest(spark, state, "base", before)
    deltas = [v for v in versions.committed(spark, state, "delta") if (base is None or v > base) and (before is None or v < before)]
    full = StructType([*schema.fields, StructField(_BATCH, LongType()), StructField(_BUCKET, IntegerType())])
    paths = ([] if base is None else [versions.folder(state, base, "base")]) + [versions.folder(state, v, "delta") for v in deltas]
    out = None
    for path in paths:  # at most one base and the deltas since the last compaction
        one = spark.read.schema(full).option("basePath", path).parquet(path)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], full) if out is None else out


def current_state(
    spark: SparkSession, state: str, schema: StructType, keys: list[str], mode: str = "upsert", before: int | None = None, buckets: list[int] | None = None,
) -> DataFrame:
    """The committed state, optionally before a batch, and of some buckets of keys only (the others are not read)."""
    return _current(spark, state, schema, keys, mode, before, buckets).select(*[F.col(f.name) for f in schema.fields])


def _current(spark, state, schema, keys, mode, before=None, buckets=None):
    rows = _stored(spark, state, schema, before)
    if buckets is not None:
        rows = rows.filter(F.col(_BUCKET).isin(buckets))
    return _one_per_key(rows, keys, [_BATCH], mode)


def compact(spark: SparkSession, state: str, schema: StructType, keys: list[str], mode: str = "upsert", after: int = COMPACT_AFTER) -> bool:
    """Write a base up to the newest delta once there are ``after`` deltas beyond the last base."""
    base = versions.newest(spark, state, "base")
    newer = [v for v in versions.committed(spark, state, "delta") if base is None or v > base]
    if len(newer) < after:
        return False
    rows = _current(spark, state, schema, keys, mode, before=newer[-1] + 1)
    return versions.write(rows.repartition(_BUCKET), state, newer[-1], "base", (_BUCKET,))


def clean(spark: SparkSession, state: str) -> None:
    """Remove bases and deltas that the newest base stands for. For a time when nobody reads older states."""
    base = versions.newest(spark, state, "base")
    if base is not None:
        for name, numbers in (("delta", versions.committed(spark, state, "delta")), ("base", versions.committed(spark, state, "base"))):
            for number in numbers:
                if number < base or (name == "delta" and number == base):
                    versions.drop(spark, state, number, name)


def ingest_arrivals(
    spark: SparkSession, arrivals: str, schema: StructType, state: str, checkpoint: str, keys: list[str], order: list[str],
    mode: str = "upsert", compact_after: int = COMPACT_AFTER,
) -> None:
    """Fold newly arrived JSON files into a state table.

    ``mode`` upsert: a later batch wins, within a batch the last row in ``order``; insert: the first row of a key stays. A
    batch that is repeated after a failure is written anew if it was not committed, and skipped if it was.
    """

    def apply(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, state, keys, order, mode)
        compact(batch.sparkSession, state, schema, keys, mode, compact_after)

    stream = spark.readStream.schema(schema).json(arrivals)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
