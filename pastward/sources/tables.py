"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pastward.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back.

    For results used several times: cuts the lineage, survives the loss of executors and,
    unlike a checkpoint of the lineage, keeps column pruning, filters and sizes for the planner.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
