"""Sharding by longest-processing-time scheduling.

Equal texts form a group that stays together. Groups, sorted by size, go to the least-loaded shard through a heap.
To keep what the heap sees bounded at any input size, only groups of at least 1/``grain`` of a mean shard are
scheduled on their own (there are at most ``shards * grain`` of them); all smaller groups are first gathered into
``shards * grain`` hash bundles, which are scheduled like groups. On small inputs a bundle is nearly always one group.
The loads of two shards never differ by more than the largest group or bundle; a bundle's size is that of a mean one but
for the chance of hashing, about 1/``grain`` of a shard.

Defined results: a null text counts as no bytes and shares the group of empty texts; repeated rows stay together and
get slots of their own; an empty table gives no rows; a null identifier sorts first; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

#: Rows of a shard that one task numbers, and the fewest parts of a shard that are numbered apart.
SLOT_ROWS, SLOT_PARTS = 1_000_000, 64


def lpt(units: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Units by falling size (then name), each to the shard with the least load so far."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for name, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, grain: int = 256) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document; size is UTF-8 bytes plus ``overhead``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(SLOT_PARTS, n // (shards * SLOT_ROWS))
    large = groups.filter(F.col("bytes") >= max(1, -(-total // (shards * grain)))).select(
        "key", "bytes", F.concat(F.lit("g"), F.col("key").cast("string")).alias("unit")
    )
    large = staged(large, "shard-large")  # at most shards * grain rows
    bundle = F.concat(F.lit("b"), F.pmod("key", F.lit(shards * grain)).cast("string"))
    placed = rows.join(F.broadcast(large.select("key", "unit")), "key", "left").withColumn("unit", F.coalesce("unit", bundle))
    sizes = placed.groupBy("unit").agg(F.sum("size").alias("bytes")).collect()  # at most 2 * shards * grain rows
    plan = spark.createDataFrame(list(lpt([tuple(r) for r in sizes], shards).items()), "unit string, shard int")
    placed = placed.join(F.broadcast(plan), "unit").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))

    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards * parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(within) - 1).alias("slot")
    )
