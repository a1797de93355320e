"""The queries of this subpackage: ``QUERIES`` by name, and ``SQL`` where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.llm import (
    html_text, lexical_search, line_dedup, mixing, near_dedup, packing, prefix_trie, quality_model, quality_rules, repeats, token_files, toxicity, whitening,
)
from pastward.llm.shared import Scratch, table
from pastward.llm.token_ids import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the token files of all documents and reads offsets and checksums back from them."""
    path = Scratch(spark, "op5").path("ids")
    token_files.write_token_files(table(spark, folder, "documents"), path, vocabulary_path())
    return token_files.read_digests(spark, path)


@_query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line within one edit, and a digest of what is left."""
    rows = line_dedup.without_repeated_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


SQL["op6_line_dedup"] = line_dedup.SQL


@_query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document, the base rules and the verdict of the cascade."""
    rows = quality_rules.judged(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op8_quality_rules"] = quality_rules.SQL


@_query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the rows that aren't held out."""
    docs = table(spark, folder, "documents")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, folder, "labels")))
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are alike to 85 percent."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


SQL["op3_near_dedup"] = near_dedup.SQL


@_query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of at most 4096 ids from all documents, filled with lexical neighbours."""
    return packing.packed(table(spark, folder, "documents"), vocabulary_path())


@_query
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in mixed order: each source as often as its tempered weight asks for."""
    rows = mixing.schedule(table(spark, folder, "documents"))
    return rows.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


@_query
def op1_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, over all documents."""
    docs, scratch = table(spark, folder, "documents"), Scratch(spark, "search")
    queries = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return lexical_search.search(lexical_search.index(docs, scratch), queries, scratch)


SQL["op1_lexical_search"] = lexical_search.SQL


@_query
def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere, too."""
    return repeats.repeated_bytes(table(spark, folder, "documents"))


@_query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector, whitened, by component."""
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    rows = whitening.whitened(vectors.select("vec_id", "embedding"), model)
    shares = [v / model.trace if model.trace else 0.0 for v in model.variances] if model else []
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained") if shares else F.lit(None).cast("double").alias("explained"),
        F.lit(whitening.identity_error(whitening.whitened(vectors.select("embedding"), model), model)).cast("double").alias("identity_error"))


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


SQL["op12_prefix_trie"] = prefix_trie.SQL


@_query
def op13_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels of the rows that aren't held out."""
    docs = table(spark, folder, "documents")
    rows = quality_model.scored(docs.select("doc_id", "text", "n_chars"), quality_model.fit(docs, table(spark, folder, "labels")))
    return rows.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))
