"""Changes of a table as a function of (table, rows): the result is a DataFrame to be written elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.history import latest_by


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the source whose key the target lacks, the first one of a repeated key."""
    rest = [c for c in source.columns if c not in keys]
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return first.join(target.select(*keys), keys, "left_anti").select(*source.columns)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return target.unionByName(insert_new(target, source, keys, order))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], set_cols: list[str], order: list[str] | None = None) -> DataFrame:
    """Source values win on matching keys, NULLs included; other columns keep the target's value.

    With ``order`` the last source row of a repeated key is used; otherwise keys must be unique.
    """
    if order is not None:
        source = latest_by(source, keys, [F.col(c) for c in order])
    new = source.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys])
    old = target.withColumn("_old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    out: list[Column] = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(F.col("_new"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif c in source.columns:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def apply_scores(predictions: DataFrame, scored: DataFrame, key: str, cols: list[str], guard: str) -> DataFrame:
    """Fill score columns of rows that are not scored yet (``guard`` is NULL); others stay untouched."""
    new = scored.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_s_{c}") for c in cols])
    open_row = F.col("_new") & F.col(guard).isNull()
    joined = predictions.join(new, key, "left")
    return joined.select(*[
        F.when(open_row, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in predictions.columns
    ])


def insert_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """One row: source rows, keys that ``insert_new`` adds, and source rows that it skips."""
    counts = source.groupBy(*keys).agg(F.count("*").alias("_n")).join(target.select(*keys).distinct().withColumn("_held", F.lit(True)), keys, "left")
    inserted = F.count_if(F.col("_held").isNull())
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return counts.agg(total.alias("source_rows"), inserted.alias("inserted"), (total - inserted).alias("skipped"))


def score_counts(predictions: DataFrame, scored: DataFrame, key: str, guard: str) -> DataFrame:
    """One row: scores given, applied, met by a row scored before, and without a row. The last three sum up to the first."""
    joined = scored.select(key).join(predictions.select(key, F.lit(True).alias("_row"), F.col(guard).isNull().alias("_open")), key, "left")
    return joined.agg(
        F.count("*").alias("given"), F.count_if(F.col("_open")).alias("applied"), F.count_if(~F.col("_open")).alias("scored_before"), F.count_if(F.col("_row").isNull()).alias("unknown"))


def assert_no_existing(rows: DataFrame, target: DataFrame, keys: list[str]) -> None:
    """Refuse rows whose key the target already holds."""
    clash = rows.join(target.select(*keys), keys, "left_semi").limit(5).collect()
    if clash:
        raise ValueError(f"keys exist already, e.g. {[tuple(r[k] for k in keys) for r in clash]}")
