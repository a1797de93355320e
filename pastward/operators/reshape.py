"""Change of grain: one row per match to one row per side, wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_rows(df: DataFrame, keep: list[str], sides: dict[str, tuple[str, str]], venues=("H", "A")) -> DataFrame:
    """Two rows per match, one per side, from a single scan.

    ``sides`` maps an output column to the input columns seen from the first and
    from the second side.
    """

    def side(index: int):
        return F.struct(
            F.lit(venues[index]).alias("venue"),
            *[F.col(pair[index]).alias(name) for name, pair in sides.items()],
        )

    return df.select(*keep, F.explode(F.array(side(0), side(1))).alias("side")).select(*keep, "side.*")


def metric_rows(df: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A one-row result as (metric, value) rows, values as text."""
    pairs = [F.struct(F.lit(c).alias(key), F.col(c).cast("string").alias(value)) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")


def struct_rows(df: DataFrame, structs: list, keep: list[str] = ()) -> DataFrame:
    """One output row per struct expression; keeps aggregates in a single pass."""
    return df.select(*keep, F.explode(F.array(*structs)).alias("row")).select(*keep, "row.*")
