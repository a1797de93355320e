"""Numbered versions of a table; only those with a commit marker count.

A version is written to ``<path>/<name>=<number>`` first, and an empty file ``<path>/_commits/<name>-<number>`` is made last, by
one operation of the file system. A job that dies in between leaves a folder no reader looks at, and its repetition
writes that folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(path: str, number: int, name: str = "v") -> str:
    return f"{path.rstrip('/')}/{name}={number}"


def committed(spark: SparkSession, path: str, name: str = "v") -> list[int]:
    """Numbers of the committed versions, ascending. A list of names of the folder of markers, one per version."""
    target, files = _files(spark, f"{path.rstrip('/')}/_commits")
    if not files.exists(target):
        return []
    found = [s.getPath().getName().rsplit("-", 1) for s in files.listStatus(target)]
    return sorted(int(number) for kind, number in found if kind == name)


def newest(spark: SparkSession, path: str, name: str = "v", before: int | None = None) -> int | None:
    """The last committed version, optionally below a number."""
    usable = [v for v in committed(spark, path, name) if before is None or v < before]
    return usable[-1] if usable else None


def write(df: DataFrame, path: str, number: int, name: str = "v", partition_by: tuple = ()) -> bool:
    """Write and commit a version; false, and nothing written, if it is committed already."""
    spark = df.sparkSession
    if number in committed(spark, path, name):
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(folder(path, number, name))
    mark(spark, path, number, name)
    return True


def mark(spark: SparkSession, path: str, number: int, name: str = "v") -> None:
    """Commit a written version."""
    target, files = _files(spark, f"{path.rstrip('/')}/_commits/{name}-{number}")
    files.create(target, False).close()


def drop(spark: SparkSession, path: str, number: int, name: str = "v") -> None:
    """Remove a version, its marker first."""
    for part in (f"{path.rstrip('/')}/_commits/{name}-{number}", folder(path, number, name)):
        target, files = _files(spark, part)
        files.delete(target, True)
