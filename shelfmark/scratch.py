"""Tables and checkpoints that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Lets Spark drop a query's shuffle files as soon as its result is written.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_HERE = threading.local()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes, in the end, all scratch tables that this thread makes inside.

    What is to outlast it must be written to a path that was made before, as results are read lazily::

        path = scratch_path(spark, "result")
        with released(spark):
            job(spark).write.parquet(path)
    """
    outer, _HERE.paths = getattr(_HERE, "paths", None), []
    try:
        yield
    finally:
        made, _HERE.paths = _HERE.paths, outer
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder where that is unset, in local mode only.

    Other executors do not see a temporary folder, so on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    if (made := getattr(_HERE, "paths", None)) is not None:
        made.append(path)
    return path


def staged(df: DataFrame, name: str, *by: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to a scratch table and read back: computed once, its lineage cut, safe if executors are lost.

    With columns ``by``, files lie in folders of their values, and filters on them read no others. Of ``schema`` it is read
    with other types that are stored alike.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(schema or df.schema).parquet(path)
