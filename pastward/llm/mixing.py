"""Mixes sources by temperature: shares of tokens to a power, realised as permutations with token budgets.

Source i with share p of all tokens gets the weight p^a / sum(p^a). The exponent a in [0, 1] is the largest whose weights have at least
the target entropy, and no smaller than the repetition limit allows; both are found by bisection, where one pass over the
table of sources does ``HALVINGS`` steps at once. Without a budget the source that is repeated least appears once, so that
no document is lost; with one, a source gets its weight of that many tokens.

A source is gone through in epochs, each a permutation of its documents by a hash; the last one ends where the
budget does. A stream of blocks takes from every source its weight of the block's tokens, and a block is permuted in
itself. Running sums go over ranges of the hash first and then inside each range, so that a source with a third of all
documents is many small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.llm.shared import SPACE_CLASS, Scratch

ENTROPY = 0.97
REPETITIONS = 2.0
BLOCK_TOKENS = 1 << 20
SEED = 17
HALVINGS = 6
PASSES = 6
#: Documents of a source in one range of the hash, about.
RANGE_DOCUMENTS = 4_096


def word_tokens(text_col: str = "text") -> Column:
    """Words of a text and one for its end; a null text has the end only."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE_CLASS}+"), ""))
    return words.cast("long") + 1


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights over its maximum, greatest repetition over the least) for each exponent."""
    share = F.log("share")
    columns = [F.count("*").alias("n"), (F.max(share) - F.min(share)).alias("spread")]
    for k, a in enumerate(exponents):
        columns += [F.sum(F.exp(share * a)).alias(f"z{k}"), F.sum(F.exp(share * a) * share).alias(f"e{k}")]
    row = sources.agg(*columns).head()
    most = math.log(row["n"]) if row["n"] > 1 else 1.0
    entropy = [(math.log(row[f"z{k}"]) - a * row[f"e{k}"] / row[f"z{k}"]) / most if row["n"] > 1 else 1.0 for k, a in enumerate(exponents)]
    return [(h, math.exp((1 - a) * row["spread"])) for h, a in zip(entropy, exponents)]


def _largest(sources: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] for which ``holds(entropy, repetition)``, which is true from 0 up to it."""
    if holds(*_measures(sources, [1.0])[0]):
        return 1.0
    low, high, steps = 0.0, 1.0, 1 << HALVINGS
    for _ in range(PASSES):
        points = [low + (high - low) * k / steps for k in range(1, steps)]
        known = [low] + [a for a, m in zip(points, _measures(sources, points)) if holds(*m)]
        low, high = known[-1], known[-1] + (high - low) / steps
    return low


def temperature(sources: DataFrame, entropy: float | None = ENTROPY, repetitions: float | None = REPETITIONS) -> float:
    """The exponent for ``sources`` (share, over 0). ``entropy``: least share of the greatest entropy possible."""
    if sources.isEmpty():
        return 1.0
    wanted = 1.0 if entropy is None else _largest(sources, lambda h, _: h >= entropy)
    if repetitions is None or _measures(sources, [wanted])[0][1] <= repetitions:
        return wanted
    # The repetition falls as the exponent grows, so its limit is met from some exponent on: bisect for that one.
    low, high, steps = wanted, 1.0, 1 << HALVINGS
    for _ in range(PASSES):
        points = [low + (high - low) * k / steps for k in range(1, steps)]
        over = [low] + [a for a, (_, r) in zip(points, _measures(sources, points)) if r > repetitions]
        low, high = over[-1], min(high, over[-1] + (high - low) / steps)
    return high


def schedule(
    docs: DataFrame, tokens: Column | None = None, entropy: float | None = ENTROPY, repetitions: float | None = REPETITIONS, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """A row per document and epoch: doc_id, text_hash, source, n_tokens, epoch, block, place (from 0 in its block).

    Rows with equal id, source and text are one document. A null source is a source of its own; null texts have one token. No rows give
    no rows. A repetition limit below 1 can't be met and acts as 1 (natural shares).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    units = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(source_col).alias("source"), (word_tokens(text_col) if tokens is None else tokens).alias("n"))
    units = scratch.keep(units.groupBy("doc_id", "text_hash", "source").agg(F.sum("n").alias("n_tokens")), "units")
    sums = units.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("documents"))
    sums = scratch.keep(sums, "sums")
    sources = sums.withColumn("share", F.col("total") / F.lit(sums.agg(F.sum("total")).head()[0]))
    exponent = temperature(sources, entropy, repetitions)

    raw = sources.withColumn("raw", F.pow("share", F.lit(exponent)))
    whole, least = raw.agg(F.sum("raw"), F.min(F.col("raw") / F.col("share"))).head()
    weighted = raw.withColumn("weight", F.col("raw") / F.lit(whole))
    copies = F.col("raw") / F.col("share") / F.lit(least) if budget is None else F.col("weight") * budget / F.col("total")
    bits = F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("documents") / RANGE_DOCUMENTS)).cast("int")))
    weighted = weighted.select(F.col("source").alias("_source"), "weight", "total", copies.alias("copies"), bits.alias("bits"))

    rows = units.join(weighted, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("copies").cast("int") - 1)))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash"))
    # The upper bits, which keep the order of the hash.
    rows = rows.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(order, 64 - bits)")))
    ranges = rows.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("range").alias("_r"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("range") == F.col("_r")))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("n_tokens").over(inside)
    rows = rows.withColumn("end", F.col("epoch") * F.col("total") + end)
    rows = rows.filter((F.col("epoch") < F.floor("copies")) | (F.col("end") <= F.col("copies") * F.col("total")))
    block = F.floor((F.col("end") - F.col("n_tokens")) / (F.col("weight") * block_tokens))
    place = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "doc_id", "text_hash", "epoch"), "doc_id", "text_hash", "epoch")
    rows = rows.withColumn("block", block.cast("long")).withColumn("place", (F.row_number().over(place) - 1).cast("long"))
    return rows.select("doc_id", "text_hash", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", "place")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule has it and in its order of blocks and places, with the columns of ``docs`` only."""
    plan = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **parameters)
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("place").alias("_place"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_own_id"), F.xxhash64(F.col(text_col)).alias("_own_hash"), F.col(source_col).alias("_own_source"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")) & F.col("_own_source").eqNullSafe(F.col("_source"))
    rows = rows.join(plan, same).select("_row", "_block", "_place")
    return rows.repartitionByRange("_block", "_place").sortWithinPartitions("_block", "_place").select("_row.*")
