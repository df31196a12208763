"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.scratch import staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node on an edge; ``component`` is the smallest node it reaches.

    Takes O(log n) rounds, also on long chains. Each round only takes minima per node (combined before the
    shuffle) and joins them back, so a node with very many edges is never gathered into one task.
    Edges with a null end and self loops are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    (e, now), before = _staged(e.distinct()), None
    while now != before and now[0]:
        before = now
        e, now = _staged(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _staged(e: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written to scratch, with their number and a sum of hashes, which are gathered as they are written."""
    seen = Observation()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    e = staged(e.observe(seen, F.count(F.lit(1)).alias("n"), mark), "cc")
    return e, (seen.get["n"], seen.get["mark"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it (itself included)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
