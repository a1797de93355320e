"""Joins with the guards a feature build needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastward.functions.scalars import text_key


def _counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows and how many of them share their key. The window is dealt by the key, as the join after it is."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def single(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has; what a guarded join can take from a table with repeated keys."""
    return _counted(df, keys, "_s").filter("_s = 1").drop("_s")


def _guard(rows: DataFrame, keys: list[str], condition: Column, message: str) -> DataFrame:
    """Fails while rows are read that break the condition."""
    key = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    return rows.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.concat(F.lit(f"{message}: "), key)).isNull())


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses a right side with repeated keys that the left side uses."""
    joined = left.join(_counted(right, keys, "_r"), keys, "left")
    return _guard(joined, keys, F.coalesce(F.col("_r"), F.lit(1)) == 1, "keys of the right side are not unique").drop("_r")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join that refuses repeated or unmatched keys on either side."""
    joined = _counted(left, keys, "_l").join(_counted(right, keys, "_r"), keys, "full")
    found = _guard(joined, keys, F.col("_l").isNotNull() & F.col("_r").isNotNull(), "keys without a match")
    return _guard(found, keys, (F.col("_l") == 1) & (F.col("_r") == 1), "keys are not unique").drop("_l", "_r")


def guarded_inner(left: DataFrame, right: DataFrame, keys: list[str], complete: bool = True, unique: bool = True) -> DataFrame:
    """Inner join that refuses, if ``unique``, repeated keys on either side and, if ``complete``, rows of the left side without a match.

    Without ``unique`` every row meets all rows of its key. Nothing is counted then, so Spark can split a key with many rows.
    """
    if not unique:
        joined = left.join(right.withColumn("_r", F.lit(1)), keys, "left" if complete else "inner")
        return (_guard(joined, keys, F.col("_r").isNotNull(), "keys without a match") if complete else joined).drop("_r")
    joined = _counted(left, keys, "_l").join(_counted(right, keys, "_r"), keys, "left" if complete else "inner")
    if complete:
        joined = _guard(joined, keys, F.col("_r").isNotNull(), "keys without a match")
    return _guard(joined, keys, (F.col("_l") == 1) & (F.col("_r") == 1), "keys are not unique").drop("_l", "_r")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def two_stage(
    left: DataFrame, right: DataFrame, row_id: str, first: str, natural: list[str], order: list[str], cols: list[str], strict: bool = False
) -> DataFrame:
    """Match by id; rows left over are matched by their natural key. Every left row is matched once at most.

    A repeated id or key of the right side means its first row in ``order``; with ``strict`` a repeated one that is
    used fails while rows are read. Both lookups are left joins and the id match wins, so the left side is read once.
    """

    def first_of(keys: list[str], name: str) -> DataFrame:
        known = right.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        return known.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias(name), F.count("*").alias(f"{name}_n"))

    joined = left.join(first_of([first], "_i"), first, "left").join(first_of(natural, "_k"), natural, "left")
    by_id = F.col("_i_n").isNotNull()
    if strict:
        joined = _guard(joined, [first], F.coalesce(F.col("_i_n"), F.lit(1)) == 1, "repeated id")
        joined = _guard(joined, natural, by_id | (F.coalesce(F.col("_k_n"), F.lit(1)) == 1), "repeated natural key")
    picked = {c: F.when(by_id, F.col(f"_i.{c}")).otherwise(F.col(f"_k.{c}")) for c in cols}
    method = F.when(by_id, "id").when(F.col("_k_n").isNotNull(), "natural_key")
    return joined.withColumns(picked | {"matched_by": method}).filter(F.col("matched_by").isNotNull()).select(
        *left.columns, *cols, "matched_by"
    )


def map_strict(df: DataFrame, col: str, mapping: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """Replace names by a mapping table; an unknown name fails while the rows are read."""
    joined = df.join(mapping.select(F.col(source).alias(col), F.col(target).alias(name)), col, "left")
    known = F.assert_true(
        F.col(name).isNotNull() | F.col(col).isNull(), F.concat(F.lit(f"unknown {col}: "), F.col(col).cast("string"))
    )
    return joined.filter(known.isNull())


def map_values(df: DataFrame, col: str, mapping: dict, name: str) -> DataFrame:
    """Replace by a fixed dictionary; an unknown value fails while the rows are read."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in mapping.items():
        out = out.when(F.col(col) == key, F.lit(value))
    mapped = df.withColumn(name, out)
    known = F.assert_true(
        F.col(name).isNotNull() | F.col(col).isNull(), F.concat(F.lit(f"unknown {col}: "), F.col(col).cast("string"))
    )
    return mapped.filter(known.isNull())


def resolve_entity(df: DataFrame, name: str, known: DataFrame, known_name: str, aliases: DataFrame) -> DataFrame:
    """Find the known spelling: exact, by alias, by text key (smallest name on ties), else the name itself.

    ``resolved_by`` says which step hit; ``cold_start`` marks names nothing is known about.
    """
    spellings = known.select(F.col(known_name).alias("_known")).distinct()
    exact = spellings.select(F.col("_known").alias(name), F.col("_known").alias("_exact"))
    alias = aliases.select(F.col("name").alias(name), F.col("alias")).join(spellings, F.col("alias") == F.col("_known")).select(name, F.col("_known").alias("_alias"))
    by_key = spellings.groupBy(text_key("_known").alias("_key")).agg(F.min("_known").alias("_similar"))
    out = df.join(exact, name, "left").join(alias, name, "left").withColumn("_key", text_key(name)).join(by_key, "_key", "left")
    step = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").when(
        F.col("_similar").isNotNull(), "normalized"
    ).otherwise("new")
    return out.withColumns({
        "resolved_name": F.coalesce("_exact", "_alias", "_similar", name), "resolved_by": step, "cold_start": step == "new",
    }).drop("_exact", "_alias", "_similar", "_key")


def overlaps(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before or when an earlier one of the entity ends; an open end never ends.

    Also marks intervals that end before they start. The latest end so far is taken over the years
    of an entity first and inside a year second, so no window holds a whole entity.
    """
    open_end = F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31")))
    rows = df.withColumns({"_open_end": open_end, "_year": F.year(start)})
    years = Window.partitionBy(*entity).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    per_year = rows.groupBy(*entity, "_year").agg(F.max("_open_end").alias("_end")).select(
        *entity, "_year", F.max("_end").over(years).alias("_years_end")
    )
    inside = Window.partitionBy(*entity, "_year").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(per_year, [*entity, "_year"], "left")
    return joined.withColumn("previous_end", F.greatest(F.max("_open_end").over(inside), "_years_end")).withColumns({
        "overlaps": F.coalesce(F.col(start) <= F.col("previous_end"), F.lit(False)),
        "invalid_range": F.coalesce(F.col(start) > F.col(end), F.lit(False)),
    }).drop("_open_end", "_year", "_years_end")
