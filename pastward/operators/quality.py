"""Data-quality checks as small result tables: one pass, one row per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import is_present
from pastward.operators.reshape import struct_rows


def rule_violations(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Rows that break each rule. As with a CHECK constraint, an unknown outcome passes."""
    conditions = {k: F.expr(v) if isinstance(v, str) else v for k, v in rules.items()}
    counts = df.agg(*[F.count_if(~v).alias(k) for k, v in conditions.items()])
    return _named_counts(counts, "rule", "violations")


def _named_counts(counts: DataFrame, name: str, value: str) -> DataFrame:
    rows = [F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias(value)) for c in counts.columns]
    return struct_rows(counts, rows)


def named_counts(df: DataFrame, counts: dict[str, Column], name: str = "check_name", value: str = "bad_rows") -> DataFrame:
    """Several aggregates of one pass as rows."""
    return _named_counts(df.agg(*[v.alias(k) for k, v in counts.items()]), name, value)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(df, keys).agg(F.count("*").alias("duplicate_groups"))


def null_profile(df: DataFrame, cols: list[str], text: list[str] = (), by: list[str] = ()) -> DataFrame:
    """NULL count and rate per column; blank text counts as NULL."""
    missing = {c: ~is_present(c) if c in text else F.col(c).isNull() for c in cols}
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows"), *[F.count_if(v).alias(c) for c, v in missing.items()])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).alias("null_count"),
            F.round(F.try_divide(c, "_rows"), 6).alias("null_rate"),
        )
        for c in cols
    ]
    return struct_rows(counts, rows, list(by))


def conditional_duplicates(df: DataFrame, cases: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """Duplicate groups under several keys, each valid for the rows of its own condition.

    All cases share one aggregation: a row belongs to the one case whose condition it meets.
    """
    case = F.coalesce(*[F.when(cond, F.lit(name)) for name, (cond, _) in cases.items()])
    used = list(dict.fromkeys(c for _, keys in cases.values() for c in keys))
    parts = [
        F.when(case.isin(*[n for n, (_, keys) in cases.items() if c in keys]), F.col(c)).alias(c) for c in used
    ]
    groups = df.select(case.alias("case_name"), *parts).groupBy("case_name", *used).agg(F.count("*").alias("n"))
    return groups.groupBy("case_name").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"),
    )


def constant_within(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Groups of several rows, and those in which some column is not constant (NULL counts as a value)."""
    spread = [
        (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in cols
    ]
    varies = reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in spread])
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), varies.alias("varies")).filter(F.col("n") > 1)
    return groups.agg(F.count("*").alias("double_groups"), F.count_if("varies").alias("leaking_groups"))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the names of the rules they break."""
    checked = df.withColumn(
        "validation_error", F.concat_ws("; ", *[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()])
    )
    return (
        checked.filter(F.col("validation_error") == "").drop("validation_error"),
        checked.filter(F.col("validation_error") != ""),
    )


def coverage(left: DataFrame, right: DataFrame, keys: list[str], names=("left", "right")) -> DataFrame:
    """Matched keys and keys missing on either side, in one full outer join of the key sets."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias(f"only_in_{names[0]}"),
        F.count_if(F.col("_a").isNull()).alias(f"only_in_{names[1]}"),
    )


def difference(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], tolerance: float = 0.0) -> DataFrame:
    """Compare two tables on a key: rows on one side only, and differing values per column.

    NULL against a value counts as different, NULL against NULL does not.
    """
    a = left.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    b = right.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    joined = a.join(b, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        if tolerance:
            return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
        return ~x.eqNullSafe(y)

    counts = {"only_left": F.count_if(F.col("_b").isNull()), "only_right": F.count_if(F.col("_a").isNull())}
    counts |= {f"differs_{c}": F.count_if(both & differs(c)) for c in cols}
    return named_counts(joined, counts, "comparison", "rows")


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def check_features(
    df: DataFrame, features: list[str], forbidden: list[str] = (), forbidden_tokens: list[str] = (), expected: int | None = None
) -> list[str]:
    """Findings on a feature list: missing, repeated, forbidden or non-numeric columns."""
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    found = []
    if expected is not None and len(features) != expected:
        found.append(f"expected {expected} features, found {len(features)}")
    checks = {
        "missing": [f for f in features if f not in types],
        "repeated": sorted({f for f in features if features.count(f) > 1}),
        "forbidden": [f for f in features if f in forbidden],
        "forbidden token in": [f for f in features if any(t in f.lower() for t in forbidden_tokens)],
        "not numeric": [f for f in features if f in types and not types[f].startswith(numeric)],
    }
    return found + [f"{name}: {cols}" for name, cols in checks.items() if cols]


def require(df: DataFrame, count_column: str = "violations") -> None:
    """Raise when a result table of checks reports any bad row. The table is small by construction."""
    bad = df.filter(F.col(count_column) > 0).limit(50).collect()
    if bad:
        raise ValueError("checks failed: " + "; ".join(str(row.asDict()) for row in bad))
