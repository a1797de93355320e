"""Helpers of the operators: reading tables, tables kept for a while in the shared folder, row iteration."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.session import ensure_checkpoint_dir

#: White space between words: fixed values of the word rule.
SPACES = " \t\n\x0b\f\r"
#: The same as a class for regular expressions, and words as its complement.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables in the shared folder of one run of an operator.

    ``keep`` writes rows once and reads them back, which cuts the lineage and survives lost executors;
    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batches, step: int = 256) -> Iterator[tuple]:
    """Tuples of the rows of Arrow batches, a few rows at a time so that long texts aren't all unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def out_batch(schema, columns: list[list]):
    """An Arrow batch of the given columns in the order of an Arrow schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


#: Bits of ``bit_filter``: its table has at most ``FILTER_BITS / 64`` rows, whatever the input.
FILTER_BITS = 1 << 20


def bit_filter(wanted: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` (long) may be among those of ``wanted``, null included; a join has to decide.

    A filter of fixed size that is broadcast, so that a join after it shuffles fewer rows. It never loses a match.
    """
    value = f"xxhash64({column})"
    word, own = F.expr(f"CAST(pmod({value}, {FILTER_BITS}) DIV 64 AS INT)"), F.expr(f"shiftleft(1L, CAST(pmod({value}, 64) AS INT))")
    words = wanted.select(word.alias("_word"), own.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    tested = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return tested.filter(F.col("_bits").bitwiseAND(own) != 0).drop("_word", "_bits")
