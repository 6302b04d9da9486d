"""Numbered folders of a stored index, each complete once its last table is.

Defined results: a folder that does not exist has no numbers; folders with other names are left alone; a
table without rows has its schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _place(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders at path with that prefix, complete or not."""
    at, fs = _place(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix(prefix)) for n in found if n.startswith(prefix) and n.removeprefix(prefix).isdecimal())


def numbers(spark: SparkSession, path: str, prefix: str, last: str) -> list[int]:
    """Numbers of those whose table `last` is complete."""
    return [n for n in names(spark, path, prefix) if exists(spark, f"{path}/{prefix}{n}/{last}/_SUCCESS")]


def newest(spark: SparkSession, path: str) -> str:
    found = numbers(spark, path, "version-", "fields")
    if not found:
        raise FileNotFoundError(f"no complete index at {path}")
    return f"{path}/version-{found[-1]}"


def columns(df: DataFrame, at: str, name: str) -> None:
    """The schema of a partitioned table, which has no file where it is empty."""
    df.limit(0).write.mode("overwrite").parquet(f"{at}/{name}-columns")


def opened(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{at}/{name}-columns").schema).parquet(f"{at}/{name}")
