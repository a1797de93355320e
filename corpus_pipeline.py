"""Cleans, thins out, mixes and packs the documents table: five stages, each one operator of ``pastward.llm``.

A stage takes what the one before it kept. All but the last return the columns of ``documents``: toxic documents go; lines that
repeat an earlier one go, with documents that have no word left; of every group of near duplicates the one with the
least id stays; sources are repeated up to their weight, none of their documents is lost; the last stage returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pastward.llm import line_dedup, mixing, near_dedup, packing, toxicity
from pastward.llm.shared import SPACES, table
from pastward.llm.token_ids import vocabulary_path
from pastward.session import ensure_checkpoint_dir

REPETITIONS = 1.5


def _packed(docs):
    """Id, text and all other columns in a struct, out of the way of columns that operators add."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _unpacked(rows, docs, **changed):
    own = {"text": F.col("text")} | changed
    return rows.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def without_toxic(spark, docs, sf_dir):
    """Documents scored below the threshold by a model of their own corpus and its labels. Null and empty texts are scored, too."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(_packed(docs), model, score_col="_toxicity")
    return _unpacked(rows.filter(F.col("_toxicity") < toxicity.THRESHOLD), docs)


def without_repeated_lines(spark, docs, sf_dir):
    """Documents without lines seen earlier; those that lose their last word go. Null texts and texts without a word stay as they are."""
    rows = line_dedup.without_repeated_lines(_packed(docs))
    rows = rows.filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(SPACES)) != ""))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row")["n_chars"])
    return _unpacked(rows, docs, n_chars=size)


def without_near_copies(spark, docs, sf_dir):
    """The document with the least id of each group; documents with a null id or without a word stay.

    Documents are told apart by id and text: one that shares its id with a copy stays if it is no copy itself.
    """
    gone = near_dedup.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.withColumn("_own_hash", F.xxhash64("text"))
    return rows.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_sources(spark, docs, sf_dir):
    """Every document at least once, those of small sources up to ``REPETITIONS`` times on average, in the order of the mixed blocks."""
    return mixing.mixed(docs, repetitions=REPETITIONS)


def packed_sequences(spark, docs, sf_dir):
    """The pieces of the packed sequences."""
    return packing.packed(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
#: The toxicity model has no SQL form; the stages are tested on planted cases and special rows.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
