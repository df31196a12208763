"""Stored models: a folder for every version, a table of versions, and a log of what the current one is."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.prefs import batch_score

_VERSION = "version int, training_samples long"


class ModelStore:
    """Versions of a model below ``root``, a folder that all executors share.

    Only rows are ever added to the tables, so a reader never meets half a change; the newest move decides which version
    is current. A version is written before the tables speak of it.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 15) -> None:
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of this store; empty as long as nothing was added."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _add(self, name: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def versions(self) -> DataFrame:
        """``version, training_samples, is_current`` of the newest ``most`` versions."""
        current = self.current()
        kept = self._table("versions", _VERSION).orderBy(F.desc("version")).limit(self.most)
        return kept.withColumn("is_current", F.col("version").eqNullSafe(F.lit(current).cast("int")))

    def current(self) -> int | None:
        last = self._table("moves", "move int, version int").agg(F.max(F.struct("move", "version"))).first()[0]
        return last["version"] if last else None

    def save(self, model: PipelineModel, samples: int) -> int:
        """Stores a model under the next version and makes it the current one."""
        version = (self._table("versions", _VERSION).agg(F.max("version")).first()[0] or 0) + 1
        model.write().overwrite().save(self._path(version))
        self._add("versions", _VERSION, version, samples)
        self._move(version)
        return version

    def rollback(self, version: int) -> None:
        """Makes another kept version current; an unknown one is an error."""
        if self.versions().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"there is no version {version}")
        self._move(version)

    def _move(self, version: int) -> None:
        last = self._table("moves", "move int, version int").agg(F.max("move")).first()[0] or 0
        self._add("moves", "move int, version int", last + 1, version)

    def _path(self, version: int) -> str:
        return f"{self.root}/models/{version:06d}"

    def score(self, features: DataFrame) -> DataFrame:
        """Scores of ``features`` by the current version."""
        version = self.current()
        if version is None:
            raise ValueError("no model is stored")
        return batch_score(PipelineModel.load(self._path(version)), features, version)
