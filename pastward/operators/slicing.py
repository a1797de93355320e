"""Where predictions fail: tables of errors by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.scalars import DRAW, LABELS
from pastward.operators.ranks import positions
from pastward.operators.reshape import struct_rows, team_rows


def bin_label(value, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin [edge, next edge); NULL outside."""
    col = F.col(value) if isinstance(value, str) else value
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        condition = F.lit(True)
        if low != float("-inf"):
            condition = condition & (col >= low)
        if high != float("inf"):
            condition = condition & (col < high)
        out = out.when(condition & col.isNotNull(), label)
    return out


def bin_table(df: DataFrame, value: str, edges: list[float], labels: list[str], columns: dict[str, Column]) -> DataFrame:
    """Aggregates per bin. Empty bins stay in, with count 0 and NULL aggregates."""
    return _complete(df.withColumn("bin", bin_label(value, edges, labels)), "bin", labels, columns)


def _complete(df: DataFrame, key: str, labels: list[str], columns: dict[str, Column]) -> DataFrame:
    """Aggregates per label, labels without rows included.

    The empty labels come in by a union of result rows. A join on the label would push a copy
    of the whole label expression down to the scan as a filter.
    """
    filled = df.groupBy(key).agg(F.count("*").alias("count"), *[v.alias(k) for k, v in columns.items()])
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in labels])).alias(key), F.lit(0).cast("bigint").alias("count"), F.lit(True).alias("_label")
    )
    both = filled.withColumn("_label", F.lit(False)).unionByName(grid, allowMissingColumns=True)
    merged = both.groupBy(key).agg(*[F.max(c).alias(c) for c in ("count", *columns, "_label")])
    return merged.filter("_label").drop("_label")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def draw_failures(df: DataFrame, actual: str) -> DataFrame:
    """Counts around missed draws."""
    drawn = F.col(actual) == DRAW
    return df.agg(
        F.count_if(drawn).alias("actual_draw_count"),
        F.count_if(F.col("argmax_prediction") == DRAW).alias("argmax_predicted_draw_count"),
        F.count_if(F.col("overlay_prediction") == DRAW).alias("overlay_predicted_draw_count"),
        F.count_if(drawn & (F.col("argmax_prediction") != DRAW)).alias("argmax_draw_miss_count"),
        F.count_if(drawn & (F.col("overlay_prediction") != DRAW)).alias("overlay_draw_miss_count"),
        F.avg(F.when(drawn, F.col("p_draw"))).alias("average_p_draw_for_draws"),
        F.avg(F.when(~drawn, F.col("p_draw"))).alias("average_p_draw_for_others"),
    )


def confidence_table(df: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    """Accuracy and loss by confidence, with each bin's share of the total loss."""
    table = bin_table(df, "confidence", edges, labels, {
        "accuracy": share(F.col("argmax_correct")),
        "mean_log_loss": F.avg("row_log_loss"),
        "total_log_loss": F.sum("row_log_loss"),
        "wrong_count": F.count_if(~F.col("argmax_correct")),
    })
    total = table.agg(F.sum("total_log_loss").alias("_all"))  # one row
    return table.join(F.broadcast(total)).withColumn(
        "log_loss_share", F.when(F.col("_all") > 0, F.col("total_log_loss") / F.col("_all")).otherwise(0.0)
    ).drop("_all")


def prediction_accuracy(df: DataFrame, actual: str, modes=("argmax", "overlay")) -> DataFrame:
    """Per predicted label: how often it was given and how often it was right."""
    aggregates = [
        F.struct(
            F.lit(x).alias("prediction"),
            *[e for m in modes for e in (
                F.count_if(F.col(f"{m}_prediction") == x).alias(f"{m}_count"),
                F.avg(F.when(F.col(f"{m}_prediction") == x, (F.col(actual) == x).cast("double"))).alias(f"{m}_accuracy"),
            )],
        ).alias(x)
        for x in LABELS
    ]
    return struct_rows(df.agg(*aggregates), [F.col(x) for x in LABELS])


def home_bias(df: DataFrame, actual: str, modes=("argmax", "overlay")) -> DataFrame:
    """Predicted against actual home wins."""
    truth = F.count_if(F.col(actual) == "H")
    out = []
    for m in modes:
        gap = F.count_if(F.col(f"{m}_prediction") == "H") - truth
        out += [
            gap.alias(f"{m}_home_overprediction"), (gap / F.count("*")).alias(f"{m}_home_rate_gap"),
            (gap > 0).alias(f"{m}_overpredicted_home"),
        ]
    return df.agg(*out)


def season_stage(df: DataFrame, season: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Early, middle or late third of the season by position in the order."""
    placed = positions(df, season, bucket, order)
    third = F.when(F.col("position") * 3 < F.col("scope_rows"), "early").when(
        F.col("position") * 3 < 2 * F.col("scope_rows"), "middle"
    ).otherwise("late")
    return placed.withColumn("season_stage", third).drop("position", "scope_rows")


def team_errors(df: DataFrame, actual: str, league: list[str]) -> DataFrame:
    """Accuracy, missed draws and loss per team, and how often it was wrongly predicted to win."""
    sides = {"team": ("home_team", "away_team"), "own_win": ("_home_label", "_away_label")}
    rows = team_rows(
        df.withColumns({"_home_label": F.lit("H"), "_away_label": F.lit("A")}),
        [*league, actual, "argmax_prediction", "argmax_correct", "overlay_prediction", "row_log_loss"],
        sides,
    )
    won = F.col("argmax_prediction") == F.col("own_win")
    return rows.groupBy(*league, "team").agg(
        F.count("*").alias("matches"),
        share(F.col("argmax_correct")).alias("argmax_accuracy"),
        share(F.col("overlay_prediction") == F.col(actual)).alias("overlay_accuracy"),
        F.count_if((F.col(actual) == DRAW) & (F.col("argmax_prediction") != DRAW)).alias("draw_miss_count"),
        F.avg("row_log_loss").alias("mean_log_loss"),
        F.count_if(won & (F.col(actual) != F.col("own_win"))).alias("overpredicted_as_winner"),
    )


def two_segments(df: DataFrame, flag: Column, names: tuple[str, str], columns: dict[str, Column]) -> DataFrame:
    """Aggregates of the rows with and without a flag; an empty segment stays in with count 0."""
    return _complete(df.withColumn("segment", F.when(flag, names[0]).otherwise(names[1])), "segment", list(names), columns)
