"""Register of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pastward.plans import views


@dataclass(frozen=True)
class Query:
    name: str
    items: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = field(default=None)


_QUERIES: dict[str, Query] = {}


def query(items: str, sql: str | None = None, name: str | None = None):
    """Decorator: ``items`` lists the inventory ids the query covers.

    The function receives the input tables (``views.Tables``); its name is the query's.
    """

    def register(function):
        key = name or function.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(views.Tables(spark, folder))

        _QUERIES[key] = Query(key, tuple(items.split()), run, None if sql is None else with_views(sql))
        return function

    return register


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    body = sql.strip()
    needed: set[str] = set()

    def visit(text: str) -> None:
        for view in views.SQL:
            if view not in needed and re.search(rf"\b{view}\b", text):
                needed.add(view)
                visit(views.SQL[view])

    visit(body)
    ctes = ",\n".join(f"{view} AS ({views.SQL[view]})" for view in views.SQL if view in needed)
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if head:
        keyword = "WITH RECURSIVE " if head.group(1) else "WITH "
        return f"{keyword}{ctes}{', ' if ctes else ''}{body[head.end():]}"
    return f"WITH {ctes}\n{body}" if ctes else body


def all_queries() -> dict[str, Query]:
    import importlib
    import pkgutil

    import pastward.plans as package

    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"pastward.plans.{module.name}")
    return dict(_QUERIES)
