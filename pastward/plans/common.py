"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAGUE = ["league"]
SEASON = ["league", "season"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round all double columns, so that the order of additions does not show."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])


def tenths(col: str):
    return F.floor(F.col(col) * 10)
