"""Feature contracts, and models stored together with theirs.

A contract is a table with one row per feature: place, name, type, and what the training rows held (nulls, range). It is as long as
the list of features, so it may be read on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.operators import decisions, models
from pastward.operators.reshape import struct_rows
from pastward.sources import versions

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
CONTRACT = "position int, feature string, type string, rows bigint, null_rows bigint, low double, high double"
SCHEMA_FINDINGS = ("missing", "repeated", "forbidden", "type")


def _usable(column: str):
    """The value as a double; NaN and infinities are null."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def feature_contract(train: DataFrame, features: list[str]) -> DataFrame:
    """The contract that training rows set up, in the order of the features. One pass."""
    types = dict(train.dtypes)
    bad = [f for f in features if not types.get(f, "none").startswith(NUMERIC)]
    if bad or not features:
        raise ValueError(f"features must be numeric columns, but are not: {bad}" if bad else "a contract needs features")
    cells = [
        F.struct(
            F.lit(k).alias("position"), F.lit(f).alias("feature"), F.lit(types[f]).alias("type"), F.count("*").alias("rows"),
            F.count_if(F.col(f"`{f}`").isNull()).alias("null_rows"), F.min(_usable(f)).alias("low"), F.max(_usable(f)).alias("high"),
        ).alias(f"_{k}")
        for k, f in enumerate(features, 1)
    ]
    return struct_rows(train.agg(*cells), [F.col(f"_{k}") for k in range(1, len(features) + 1)])


def contract_findings(df: DataFrame, contract: DataFrame, forbidden: tuple = (), tokens: tuple = ()) -> DataFrame:
    """What keeps rows from meeting a contract: (position, feature, finding, rows), one row per finding.

    Of the schema: missing, repeated, forbidden (by name or by a part of it), type. Of the values: not_finite, more_nulls (a larger
    share than in training), outside_training_range. Values are looked at where the type is right. One pass over the rows.
    """
    lines = contract.orderBy("position").collect()  # a row per feature
    types, names = dict(df.dtypes), [line["feature"] for line in lines]
    found = []
    for line in lines:
        name, rows = line["feature"], F.count("*")
        findings = {
            "missing": rows if name not in types else None,
            "repeated": rows if names.count(name) > 1 else None,
            "forbidden": rows if name in forbidden or any(t in name.lower() for t in tokens) else None,
            "type": rows if name in types and types[name] != line["type"] else None,
        }
        if types.get(name) == line["type"]:
            value, column = _usable(name), F.col(f"`{name}`")
            nulls = F.count_if(column.isNull())
            more = nulls * F.lit(line["rows"]) > F.lit(line["null_rows"]) * rows
            outside = F.lit(False) if line["low"] is None else (value < line["low"]) | (value > line["high"])
            findings |= {
                "not_finite": F.count_if(column.isNotNull() & value.isNull()), "more_nulls": F.when(more, nulls).otherwise(0).cast("bigint"),
                "outside_training_range": F.count_if(outside),
            }
        for finding, count in findings.items():
            if count is not None:
                found.append(F.struct(F.lit(line["position"]).alias("position"), F.lit(name).alias("feature"), F.lit(finding).alias("finding"), count.alias("rows")))
    if not found:
        raise ValueError("the contract has no features")
    table = struct_rows(df.agg(*[f.alias(f"_{k}") for k, f in enumerate(found)]), [F.col(f"_{k}") for k in range(len(found))])
    return table.filter(F.col("finding").isin(*SCHEMA_FINDINGS) | (F.col("rows") > 0))


@dataclass(frozen=True)
class SavedModel:
    """A fitted pipeline with the contract of its features and the draw threshold that goes with it."""

    name: str
    model: PipelineModel
    contract: DataFrame
    draw_threshold: float
    feature_count: int

    @property
    def features(self) -> list[str]:
        return [r["feature"] for r in self.contract.orderBy("position").collect()]


def artifact_errors(saved: SavedModel) -> list[str]:
    """What is wrong with a stored model by itself."""
    features, errors = saved.features, []
    if len(features) != saved.feature_count:
        errors.append(f"{saved.feature_count} features were stored, the contract lists {len(features)}")
    repeated = sorted({f for f in features if features.count(f) > 1})
    if repeated:
        errors.append(f"repeated features: {repeated}")
    if not 0 <= saved.draw_threshold <= 1:
        errors.append(f"draw threshold outside 0..1: {saved.draw_threshold}")
    first = saved.model.stages[0]
    if isinstance(first, (Imputer, ImputerModel)) and list(first.getInputCols()) != features:
        errors.append("the model reads other features, or in another order, than the contract lists")
    return errors


def save_model(saved: SavedModel, path: str) -> int:
    """Store the next version: the pipeline, its contract and its settings, committed together."""
    errors = artifact_errors(saved)
    if errors:
        raise ValueError("; ".join(errors))
    spark = saved.contract.sparkSession
    last = versions.newest(spark, path)
    number = 0 if last is None else last + 1
    folder = versions.folder(path, number)
    saved.model.write().overwrite().save(f"{folder}/model")
    saved.contract.coalesce(1).write.mode("overwrite").parquet(f"{folder}/contract")
    settings = spark.range(1).select(
        F.lit(saved.name).alias("name"), F.lit(float(saved.draw_threshold)).alias("draw_threshold"), F.lit(saved.feature_count).alias("feature_count"))
    settings.write.mode("overwrite").parquet(f"{folder}/settings")
    versions.mark(spark, path, number)
    return number


def load_model(spark: SparkSession, path: str, version: int | None = None) -> SavedModel:
    """The newest committed version, or a given one; refused if its parts do not fit together."""
    known = versions.committed(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed model at {path}" + ("" if version is None else f", version {version}"))
    folder = versions.folder(path, known[-1] if version is None else version)
    settings = spark.read.parquet(f"{folder}/settings").head()
    saved = SavedModel(
        settings["name"], PipelineModel.load(f"{folder}/model"), spark.read.schema(CONTRACT).parquet(f"{folder}/contract"),
        settings["draw_threshold"], settings["feature_count"],
    )
    errors = artifact_errors(saved)
    if errors:
        raise ValueError("; ".join(errors))
    return saved


def predict(saved: SavedModel, rows: DataFrame) -> DataFrame:
    """Rows with probabilities and the label by the stored draw threshold. Rows without the contract's columns and types are refused."""
    types = dict(rows.dtypes)
    lines = saved.contract.orderBy("position").collect()
    bad = [f"{r['feature']} is {types.get(r['feature'], 'missing')}, not {r['type']}" for r in lines if types.get(r["feature"]) != r["type"]]
    if bad:
        raise ValueError("; ".join(bad))
    scored = models.predict_classes(saved.model, rows)
    return scored.withColumn("label", decisions.overlay_label(F.lit(saved.draw_threshold)))
