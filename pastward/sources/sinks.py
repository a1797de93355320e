"""Writers. Each is one distributed Parquet write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Full refresh of a table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def replace_slice(df: DataFrame, path: str, part: dict[str, object]) -> None:
    """Replace one slice of a partitioned table, also by nothing.

    Rows outside the slice are refused. Spark names and overwrites the slice's folder; a slice that becomes empty is
    deleted, by the name Spark gives it.
    """
    inside = F.lit(True)
    for column, value in part.items():
        inside = inside & F.col(column).eqNullSafe(F.lit(value))
    checked = df.filter(F.assert_true(inside, F.lit(f"row outside the slice {part}")).isNull())
    if checked.isEmpty():
        jvm = df.sparkSession.sparkContext._jvm
        names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = "/".join([path.rstrip("/"), *[names.getPartitionPathString(c, None if v is None else str(v)) for c, v in part.items()]])
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    else:
        replace_slices(checked, path, list(part))


def replace_slices(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace every slice that occurs in the rows, leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_run(df: DataFrame, path: str, run_id: int, column: str = "run_id") -> None:
    """Add a snapshot under its run id. A run that is repeated takes the place of its first try."""
    replace_slice(df.withColumn(column, F.lit(run_id)), path, {column: run_id})


def store_clusters(df: DataFrame, path: str, cluster: str, expected: int) -> None:
    """Replace the stored cluster assignments, then check that all rows and clusters arrived."""
    overwrite(df, path)
    stored = df.sparkSession.read.parquet(path)
    rows, clusters = stored.agg(F.count("*"), F.countDistinct(cluster)).first()
    if clusters != expected:
        raise ValueError(f"expected {expected} clusters in {rows} rows, found {clusters}")
