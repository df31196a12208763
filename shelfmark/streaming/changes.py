"""Change detection as a keyed stream: what the last two scans saw of every path is kept as state, not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.scratch import staged

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect_changes(spark: SparkSession, listings: DataFrame, table: str, checkpoint: str, hash_version: int) -> None:
    """Takes in the new files of the stream ``listings`` and writes the changes of its latest scan to ``table``.

    ``listings``: ``scan, file_path, file_size, file_modified, hash_version``, scans numbered from 1 without gaps. The
    state of a path, in RocksDB, is what the last scan of an even and that of an odd number saw of it, so it does not grow
    with the number of scans; a later run continues from the checkpoint. A path in the latest scan but not in the one
    before is new, one in that alone has vanished, and one in both is unchanged if size, time and ``hash_version`` are.
    ``table``: ``file_path, change, scan``, a folder a scan; a replayed batch replaces the folder it wrote. If a run takes
    in several scans, it writes the changes of the last. Of several rows of a path in one scan the greatest counts.
    """
    seen = F.struct("scan", "file_size", "file_modified", "hash_version")
    even, odd = (F.max(F.when(F.col("scan") % 2 == k, seen)).alias(name) for k, name in enumerate(("even", "odd")))
    state = listings.groupBy("file_path").agg(even, odd)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        run = state.writeStream.outputMode("complete").foreachBatch(lambda rows, _: _write(rows, table, hash_version))
        run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _write(rows: DataFrame, table: str, hash_version: int) -> None:
    rows = staged(rows, "path-states")
    last = rows.agg(F.max(F.greatest("even.scan", "odd.scan"))).first()[0]
    if last is None:
        return
    now, before = _of(last), _of(last - 1)
    changed = rows.select("file_path", _kind(now, before, hash_version).alias("change"), F.lit(last).alias("scan")).filter("change is not null")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(table)


def _of(scan: int) -> Column:
    slot = F.col("odd" if scan % 2 else "even")
    return F.when(slot["scan"] == scan, slot)


def _kind(now: Column, before: Column, hash_version: int) -> Column:
    same = before["hash_version"].eqNullSafe(F.lit(hash_version))
    for c in ("file_size", "file_modified"):
        same = same & now[c].eqNullSafe(before[c])
    both = now.isNotNull() & before.isNotNull()
    return F.when(both & same, "unchanged").when(both, "changed").when(now.isNotNull(), "new").when(before.isNotNull(), "vanished")
