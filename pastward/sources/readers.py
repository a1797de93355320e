"""Readers for files and stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import is_present


def filter_by(df: DataFrame, **conditions) -> DataFrame:
    """Keep rows that meet all conditions that are given; None means no condition.

    A value means equality, a list membership, a tuple (operator, value) a comparison.
    """
    compare = {
        "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
        "is null": lambda a, b: a.isNull() == F.lit(bool(b)),
    }

    def condition(name: str, wanted) -> Column:
        if isinstance(wanted, tuple):
            return compare[wanted[0]](F.col(name), wanted[1])
        if isinstance(wanted, (list, set)):
            return F.col(name).isin(list(wanted))
        return F.col(name) == wanted

    parts = [condition(k, v) for k, v in conditions.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def completed_only(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose required fields are all known and not blank."""
    return df.filter(reduce(lambda a, b: a & b, [is_present(c) for c in required]))
