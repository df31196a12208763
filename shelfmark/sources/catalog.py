"""Sources and sinks: file catalogs, tracks, snapshots, logs, and what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import classify, file_name, relative_path

_POINT = "_lat double, _lon double, time timestamp"


def scan_files(spark: SparkSession, root: str, task_id: int, offset_hours: int = 8) -> DataFrame:
    """Catalog rows of all files below ``root``. Contents are pruned from the scan and never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace("path", r"^file:/*", "/")
    modified = F.col("modificationTime").cast("timestamp_ntz")
    out = rows.select(
        F.lit(task_id).cast("long").alias("task_id"),
        F.xxhash64(path).alias("file_id"),
        path.alias("file_path"),
        relative_path(path, base).alias("relative_path"),
        file_name(path).alias("file_name"),
        F.col("length").alias("file_size"),
        F.lit(None).cast("timestamp_ntz").alias("file_created"),
        (modified + F.make_dt_interval(hours=F.lit(offset_hours))).alias("file_modified"),
    )
    return classify(out)


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    """``file_id, content`` of all files below ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.xxhash64(F.regexp_replace("path", r"^file:/*", "/")).alias("file_id"), "content")


def table_of_task(spark: SparkSession, path: str, task_id: int) -> DataFrame:
    """One task of a table partitioned by ``task_id``; other partitions are not read."""
    return spark.read.parquet(path).filter(F.col("task_id") == task_id)


def read_tracks(spark: SparkSession, paths: list[str], task_id: int) -> DataFrame:
    """Timed track and route points of track files, in the order of ``paths``, as UTC."""
    out = None
    for rank, path in enumerate(paths):
        for kind, tag in enumerate(("trkpt", "rtept")):
            rows = spark.read.format("xml").option("rowTag", tag).schema(_POINT).load(path).filter("time is not null")
            rows = rows.select(
                F.lit(task_id).cast("long").alias("task_id"), F.lit(rank).alias("source_rank"),
                (F.monotonically_increasing_id() + F.lit(kind * (1 << 60))).alias("point_seq"),
                F.col("time").cast("timestamp_ntz").alias("ts"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def write_track(points: DataFrame, path: str) -> None:
    """``ts`` (UTC), ``lat`` and ``lng`` as track files, one for each partition."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")
    rows = points.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lon"), time)
    rows.write.format("xml").option("rootTag", "gpx").option("rowTag", "trkpt").save(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the tasks in ``df`` and leaves all other tasks alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def pending(catalog: DataFrame, derived: DataFrame) -> DataFrame:
    """Catalog rows that the derived table does not have yet."""
    return catalog.join(derived.select("file_id"), "file_id", "left_anti")


def changes(old: DataFrame, new: DataFrame, hash_version: int | None = None) -> DataFrame:
    """``file_path, change``: new, changed, unchanged or vanished, by size, modification time and hash version."""
    o = old.select("file_path", F.struct("file_size", "file_modified", "hash_version").alias("o"))
    n = new.select("file_path", F.struct("file_size", "file_modified").alias("n"))
    same = F.col("o.file_size").eqNullSafe(F.col("n.file_size")) & F.col("o.file_modified").eqNullSafe(F.col("n.file_modified"))
    if hash_version is not None:
        same = same & F.col("o.hash_version").eqNullSafe(F.lit(hash_version))
    kind = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "vanished").when(same, "unchanged").otherwise("changed")
    return o.join(n, "file_path", "full").select("file_path", kind.alias("change"))
