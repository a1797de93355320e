"""Features from earlier rows of the same entity.

Two cut-offs exist and are kept apart:

* ``prior_strict``: only rows with a strictly earlier time count; rows of equal time
  never see one another.
* ``prior_rows``: the n rows before in a total order count, whatever their time.

Neither hands a whole entity to one task. Rows are cut into (entity, block)
groups, where the block is a function of the time; each group is reduced to its last
n rows, and only these small tails travel along the entity. So a single entity that holds a third of all rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tails(df: DataFrame, keys: list[str], order: list[str], cols: list[str], n: int, name: str = "tail") -> DataFrame:
    """Per key the last n rows as an array of structs, newest first.

    The rank filter is applied before the shuffle too (window group limit), so at
    most n rows per key and task move.
    """
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.select(*dict.fromkeys([*keys, *order, *cols]))
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, *cols]))), asc=False).alias(name))
    )


def carried(df: DataFrame, entity: list[str], block: str, order: list[str], cols: list[str], n: int) -> DataFrame:
    """Per (entity, block) the last n rows of all earlier blocks, newest first, as ``history``.

    Every block in the table holds at least one row, so the n blocks before are enough.
    """
    earlier = Window.partitionBy(*entity).orderBy(F.col(block).desc()).rowsBetween(1, n)
    return tails(df, [*entity, block], order, cols, n).select(
        *entity, block, F.slice(F.flatten(F.collect_list("tail").over(earlier)), 1, n).alias("history")
    )


def prior_strict(
    df: DataFrame, entity: list[str], time: str, tiebreak: list[str], cols: list[str], n: int
) -> DataFrame:
    """One row per (entity, time) with ``history``: the last n strictly earlier rows, newest first."""
    return carried(df, entity, time, tiebreak, cols, n)


def carried_by_kind(
    df: DataFrame, entity: list[str], block: str, kind: str, order: list[str], cols: list[str], n: int, n_kind: int, kinds: int = 3
) -> DataFrame:
    """Per (entity, block, kind), from earlier blocks and newest first: the last n rows of the entity as ``history``, its last ``n_kind`` of this kind as ``kind_history``.

    Two frames from one scan: rows shrink to tails per (entity, block, kind), and both windows run over these tails
    in one partitioning by entity. ``kinds`` bounds the kinds in a block, null being one; that many rows more are looked back for, because
    those of the block itself do not count, and the oldest block may be cut between its kinds.
    """
    per_block = tails(df, [*entity, block, kind], [block, *order], cols, max(n, n_kind))
    newest = [F.col(block).desc(), F.col(kind).desc()]
    overall = Window.partitionBy(*entity).orderBy(*newest).rowsBetween(1, n + 2 * (kinds - 1))
    own = Window.partitionBy(*entity, kind).orderBy(F.col(block).desc()).rowsBetween(1, n_kind)
    seen = per_block.withColumns({"_all": F.flatten(F.collect_list("tail").over(overall)), "_own": F.flatten(F.collect_list("tail").over(own))})
    earlier = F.filter("_all", lambda row: row[block] < F.col(block))
    return seen.select(
        *entity, block, kind, F.slice(F.sort_array(earlier, asc=False), 1, n).alias("history"), F.slice("_own", 1, n_kind).alias("kind_history")
    )


def history_count(n: int, history: str = "history") -> Column:
    return F.least(F.size(history), F.lit(n))


def history_mean(value: str, n: int, history: str = "history", min_rows: int | None = None) -> Column:
    """Mean of a field over the last n rows of a history; NULL when there is no value.

    With ``min_rows`` the mean is NULL as well when fewer rows exist; the condition is part of the divisor, because a
    branch around the sum would keep Spark from sharing its parts. The sum is written out
    over the n places, which compiles, where array functions with lambdas would be interpreted.
    """
    places = [f"CAST(get({history}.{value}, {i}) AS DOUBLE)" for i in range(n)]
    total = " + ".join(f"coalesce({p}, 0D)" for p in places)
    known = " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in places)
    enough = "" if min_rows is None else f" * nullif(CAST(least(size({history}), {n}) >= {min_rows} AS INT), 0)"
    return F.expr(f"try_divide({total}, nullif({known}, 0){enough})")


def with_carry_rows(df: DataFrame, entity: list[str], block: str, order: list[str], n: int, lead: str) -> DataFrame:
    """The rows plus, in front of every (entity, block), copies of the n rows before it.

    ``lead`` is 0 for rows of the block and negative, ascending, for the copies. Windows
    that look back at most n rows can then run per (entity, block).
    """
    cols = [c for c in df.columns if c not in {*entity, block, *order}]
    copies = carried(df, entity, block, order, cols, n).select(
        *entity, block, F.posexplode("history").alias("_at", "row")
    )
    copies = copies.select(*entity, block, "row.*", (-F.col("_at") - 1).alias(lead))
    return df.withColumn(lead, F.lit(0)).unionByName(copies)


def prior_rows(
    df: DataFrame, entity: list[str], block: str, order: list[str], n: int, features: dict[str, Column]
) -> DataFrame:
    """Aggregates over the n rows before, in the order (block, *order) of the entity.

    ``block`` must not decrease along the order; it decides how finely one entity is split.
    """
    frame = Window.partitionBy(*entity, block).orderBy("_lead", *order).rowsBetween(-n, -1)
    return (
        with_carry_rows(df, entity, block, order, n, "_lead")
        .withColumns({name: aggregate.over(frame) for name, aggregate in features.items()})
        .filter(F.col("_lead") == 0)
        .drop("_lead")
    )


def prior_rows_by_kind(
    df: DataFrame, entity: list[str], block: str, kind: str, order: list[str], n: int, features: dict[str, Column], kind_features: dict[str, Column], kinds: int = 3
) -> DataFrame:
    """As ``prior_rows``, with ``kind_features`` over the n rows before that are of the row's own kind.

    The order (block, *order) must be total. The copies in front of a block are the last n rows of the entity and of each kind
    in the block; older rows of a kind never come between the last n of all, so both frames read the same copies.
    """
    cols = [c for c in df.columns if c not in {*entity, block, *order}]
    both = carried_by_kind(df, entity, block, kind, order, cols, n, n, kinds)
    needed = F.array_distinct(F.flatten(F.collect_list(F.array_union("history", "kind_history"))))
    copies = both.groupBy(*entity, block).agg(F.sort_array(needed, asc=False).alias("rows"))
    copies = copies.select(*entity, block, F.posexplode("rows").alias("_at", "row"))
    copies = copies.select(*entity, block, *[F.col(f"row.{c}") for c in (*order, *cols)], (-F.col("_at") - 1).alias("_lead"))
    frame = Window.partitionBy(*entity, block).orderBy("_lead", *order).rowsBetween(-n, -1)
    own = Window.partitionBy(*entity, block, kind).orderBy("_lead", *order).rowsBetween(-n, -1)
    windowed = {name: a.over(frame) for name, a in features.items()} | {name: a.over(own) for name, a in kind_features.items()}
    return df.withColumn("_lead", F.lit(0)).unionByName(copies).withColumns(windowed).filter(F.col("_lead") == 0).drop("_lead")


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the largest order value per key, NULLs counting as smallest.

    A plain aggregate, so it combines before the shuffle and a hot key is no problem.
    The order must be total.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
