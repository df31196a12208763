"""Mixing sources to target weights by balanced sampling with the cube method (Deville and Tillé 2004).

A source's target over its size is how often each of its documents is to be taken on average: the whole part of that is
taken of every document, the fraction is the probability of one more copy. The flight moves these probabilities three
documents at a time along the null space of the two balancing constraints, the source's documents and its tokens, until
each but a few is 0 or 1; both totals stay what they were. Blocks of a source fly apart, what they leave over flies
together in ever fewer blocks, and of the last ``LANDING`` documents of a source those are taken that bring its tokens
nearest to the target (then its documents, then in the order of the documents). Large documents fly first, so that small
ones are left to land. A long document that is left over can still miss the target by much of its length: documents of that
last block whose sizes are nearest to what is missing are then flipped, a few at most.

Blocks and random numbers depend on identifiers, sizes and sources alone, so that reruns agree however rows are spread.

Defined results: a null or empty text has size 0, takes no part and gets nothing; a null source is a source of its own,
the last; repeated rows are documents of their own and may get different numbers of copies; an empty table gives no rows;
a null identifier is kept as null; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

#: Documents that fly in one task's block, and documents of a block whose fate is left to the next round.
BLOCK, LANDING = 10_000, 8
#: Ranges in which sources are numbered apart.
RANGES = 16
_EPS = 1e-9
_UNITS = "at long, doc_id long, size long, hash long, chance double, blocks long, fate int"


def n_words(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text holds; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(rows: DataFrame) -> DataFrame:
    """``source, at, source_size, documents``: sources by code point, null last, from 0; ranges are numbered apart and added up."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("documents"))
    order = [F.col("source").isNull(), F.col("source")]
    sources = staged(sources.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sources.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))  # RANGES rows
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return sources.join(F.broadcast(starts), "range").select("source", (nth + F.col("start")).alias("at"), "source_size", "documents")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, none above ``most`` times its source's size.

    The level is the target of weight 1. It rises while sources reach their bound; each step is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    sources = staged(sources.withColumns({"weight": weight, "bound": most * F.col("source_size")}), "mix-weights")
    level, total = 0.0, sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.col("bound") <= F.col("weight") * F.lit(level)
        fixed, free = sources.agg(F.sum(F.when(full, F.col("bound")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        raised = (total - fixed) / free if free else level
        if raised <= level:
            break
        level = raised
    full = F.col("bound") <= F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(full, F.col("bound").cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("weight", "bound")


def flight(sizes: list[int], chances: list[float], draw: random.Random, stop: int) -> list[float]:
    """Probabilities after the flight: all 0 or 1 but for ``stop`` at most (or 2, if more)."""
    p, open_, entering = list(chances), [], iter(range(len(sizes)))
    left = sum(_EPS < c < 1 - _EPS for c in p)
    while left > max(stop, 2):
        while len(open_) < 3:
            i = next(entering)
            if _EPS < p[i] < 1 - _EPS:
                open_.append(i)
        i, j, k = open_
        # orthogonal to (1, 1, 1) and to the sizes: no move along it changes the documents or the tokens
        along = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if not any(along):
            along = (1, -1, 0)
        up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(open_, along, strict=True) if d)
        down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(open_, along, strict=True) if d)
        step = up if draw.random() * (up + down) < down else -down
        for x, d in zip(open_, along, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + step * d))
            if not _EPS < p[x] < 1 - _EPS:
                p[x] = round(p[x])
                left -= 1
        open_ = [x for x in open_ if 0 < p[x] < 1]
    return p


def land(sizes: list[int], chances: list[float]) -> list[int]:
    """0 or 1 for each of a few documents: nearest to the expected tokens, then documents, then the earliest choice."""
    ways = (np.arange(1 << len(sizes))[:, None] >> np.arange(len(sizes))) & 1
    tokens = np.abs(ways @ np.array(sizes, float) - np.dot(sizes, chances)).round(6)
    documents = np.abs(ways.sum(1) - sum(chances)).round(6)
    return ways[np.lexsort((documents, tokens))[0]].tolist()


def make_up(sizes: list[int], fates: list[int], error: float) -> list[int]:
    """Fates with the tokens' error lessened: while one flip lessens it, that of the size nearest to it."""
    s, f = np.array(sizes, float), np.array(fates)
    while len(s):
        after = np.abs(error + np.where(f == 1, -s, s))
        best = int(np.argmin(after))
        if after[best] > abs(error) - 0.5:
            break
        error += -s[best] if f[best] else s[best]
        f[best] = 1 - f[best]
    return f.tolist()


def _fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a source; the only block of a source lands as well."""
    at, block, blocks = key
    rows = rows.sort_values(["size", "hash", "doc_id"], ascending=[False, True, True], kind="stable")
    sizes, chances = rows["size"].tolist(), rows["chance"].tolist()
    p = flight(sizes, chances, random.Random(f"{at} {block} {blocks}"), LANDING)
    if blocks == 1:
        over = [i for i, c in enumerate(p) if 0 < c < 1]
        for i, fate in zip(over, land([sizes[i] for i in over], [p[i] for i in over]), strict=True):
            p[i] = fate
        p = make_up(sizes, p, float(np.dot(sizes, p) - np.dot(sizes, chances)))
    rows["chance"] = p
    rows["fate"] = [int(c) if c in (0, 1) else -1 for c in p]
    return rows[["at", "doc_id", "size", "hash", "chance", "blocks", "fate"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source`` of every document; ``block`` must be above ``LANDING``."""
    rows = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-rows")
    sources = with_targets(numbered_sources(rows), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.least(F.floor(rate), F.lit(most)).cast("int")).withColumn("chance", rate - F.col("whole"))
    sources = staged(sources.withColumn("blocks", F.ceil(F.col("documents") / block)), "mix-targets")

    fractions = sources.select(F.col("source").alias("of"), "at", "chance", "blocks")
    units = rows.join(fractions, F.col("source").eqNullSafe(F.col("of")))  # Spark broadcasts the sources only where they are few
    units = units.select("at", "doc_id", "size", F.xxhash64("doc_id", "size").alias("hash"), "chance", "blocks")
    drawn = (F.col("size") > 0) & (F.col("chance") > _EPS) & (F.col("chance") < 1 - _EPS)
    fates = [units.filter(~drawn).select("at", "doc_id", "size", F.round("chance").cast("int").alias("fate"))]
    blocks, units = sources.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0], units.filter(drawn)
    while blocks:
        dealt = units.withColumn("block", F.pmod("hash", "blocks"))
        flown = staged(dealt.groupBy("at", "block", "blocks").applyInPandas(_fly, _UNITS), "mix-flight")
        fates.append(flown.filter("fate >= 0").select("at", "doc_id", "size", "fate"))
        units = flown.filter("fate < 0").drop("fate").withColumn("blocks", F.ceil(F.col("blocks") * LANDING / block))
        blocks = math.ceil(blocks * LANDING / block) if blocks > 1 else 0

    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("fate")).otherwise(0).cast("int")
    settled = functools.reduce(DataFrame.unionByName, fates).join(sources, "at").withColumn("copies", copies)
    return settled.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
