"""Exact deduplication as a stateful stream.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Each document is reduced
to a fingerprint row (digest of the normalised text, identifier, length, locator of its file); a Structured
Streaming aggregation keeps, per digest and without expiry, the group size and the row that stays in a RocksDB
state store. Every hit is then compared in full with the text of the row that stays; should two different texts
share a digest, they are grouped anew by the text itself.

Defined results: a null text counts as empty; empty texts are one group; of equal texts the one with the most code
points, then the smallest identifier, stays (a null identifier loses to any other); repeated rows (same identifier,
same text) share their fate; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.scratch import scratch_path, staged

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changes are uploaded instead of whole snapshots; files are not blown up ahead (4 MB for each state partition).
_OPTIONS = {
    _PROVIDER: _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space; null gives the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def stream_groups(spark: SparkSession, fingerprints: DataFrame, path: str, state_dir: str, files_per_batch: int) -> DataFrame:
    """Feeds the fingerprint files below ``path`` that ``state_dir`` has not seen through the keyed state.

    Returns the newest state of every digest touched: ``digest, group_size, keep_id, keep_file``.
    Calling it again with the same ``state_dir`` after more files have arrived continues from the kept state.
    """
    out = scratch_path(spark, "dedup-changes")
    rank = F.struct("n_points", F.bitwise_not(F.col("doc_id")).alias("order"), "doc_id", "file")
    grouped = (
        spark.readStream.schema(fingerprints.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(rank).alias("best"))
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in _OPTIONS}
    for key, value in _OPTIONS.items():
        spark.conf.set(key, value)
    try:
        query = (
            grouped.writeStream.outputMode("update")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .foreachBatch(append)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    schema = f"digest string, group_size bigint, best {grouped.schema['best'].dataType.simpleString()}, batch int"
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out) if query.lastProgress else None
    if changes is None:
        return spark.createDataFrame([], schema).selectExpr("digest", "group_size", "best.doc_id keep_id", "best.file keep_file")
    newest = changes.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "best")).alias("s"))
    return newest.selectExpr("digest", "s.group_size", "s.best.doc_id keep_id", "s.best.file keep_file")


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_hex,
    state_dir: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, keep_file``.

    A micro-batch takes ``files_per_batch`` fingerprint files; by default 64, or a sixteenth of them if that is more, so
    that the number of state commits does not grow with the input.
    """
    spark = docs.sparkSession
    n_points = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points")
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"), n_points)
    prints = docs.select(
        "doc_id",
        digest(normalised(F.col("text"))).alias("digest"),
        n_points,
        F.input_file_name().alias("file"),
        sha256_hex(normalised(F.col("text"))).alias("sha") if digest is not sha256_hex else F.lit(None).cast("string").alias("sha"),
    )
    path = scratch_path(spark, "dedup-prints")
    prints.write.parquet(path)
    prints = spark.read.schema(prints.schema).parquet(path)
    files_per_batch = files_per_batch or max(64, len(prints.inputFiles()) // 16)
    groups = stream_groups(spark, prints, path, state_dir or scratch_path(spark, "dedup-state"), files_per_batch)
    rows = staged(
        prints.join(groups, "digest").select(
            "doc_id", "keep_id", "group_size", "digest", F.coalesce("sha", "digest").alias("text_sha256"), "keep_file"
        ),
        "dedup-rows",
    )

    hits = rows.filter("group_size > 1 and not (doc_id <=> keep_id)").select("doc_id", "keep_id", "digest").distinct()
    keepers = hits.select(F.col("keep_id").alias("doc_id"), "digest").distinct()
    found = _texts_of(texts, hits, digest)
    kept = _texts_of(texts, keepers, digest).select("digest", "norm")
    differs = staged(found.join(kept, ["digest", "norm"], "left_anti"), "dedup-differs")
    if not differs.isEmpty():
        rows = _regrouped(rows, differs)
    return rows.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_file"
    )


def _texts_of(texts: DataFrame, wanted: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The wanted rows with their normalised text, fetched by identifier and confirmed by digest."""
    t = texts.withColumnRenamed("doc_id", "id")
    return wanted.join(t, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id").filter(digest(F.col("norm")) == F.col("digest"))


def _regrouped(rows: DataFrame, differs: DataFrame) -> DataFrame:
    """Splits the groups in which different texts share a digest: those unlike the keeper are grouped by their text."""
    own = differs.groupBy("digest", "norm").agg(
        F.count("*").alias("own_size"),
        F.max(F.struct("n_points", F.bitwise_not(F.col("doc_id")).alias("order"), "doc_id")).alias("best"),
    )
    moved = differs.join(own, ["digest", "norm"]).select("doc_id", "digest", "own_size", F.col("best.doc_id").alias("own_keep")).distinct()
    lost = differs.groupBy("digest").agg(F.count("*").alias("lost"))
    left = rows.join(moved.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").join(lost, "digest", "left")
    left = left.withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).select(rows.columns)
    apart = rows.join(moved, ["doc_id", "digest"]).withColumns({"keep_id": F.col("own_keep"), "group_size": F.col("own_size")})
    return left.unionByName(apart.select(rows.columns))
