"""A label table that takes in changes partition by partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.scratch import staged

KEY = ["file_id", "task_id"]
#: Parts of a label table; also the most values that the driver holds when changes are merged.
PARTS = 64


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int").alias("part")


def write_labels(labels: DataFrame, path: str, parts: int = PARTS) -> None:
    """The whole table, in ``parts`` folders by a hash of the key."""
    labels.withColumn("part", _part(parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def touched(spark: SparkSession, path: str, changes: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows of those folders that hold a key of the changes; no other is read."""
    found = [r["part"] for r in changes.select(_part(parts)).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("part").isin(found))


def merge_labels(spark: SparkSession, path: str, changes: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS) -> None:
    """``upsert`` of the old rows and the changes, read from and written to the folders that hold a key of the changes.

    The result is complete before a folder is replaced. A run that was lost half way can be repeated, as the upserts give
    the same rows for changes that are in the table already.
    """
    changes = staged(changes, "label-changes")
    old = touched(spark, path, changes, parts).drop("part")
    new = staged(upsert(old, changes).select(old.columns), "labels-merged")
    new.withColumn("part", _part(parts)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
