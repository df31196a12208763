"""Sorted pages. Nulls come first ascending and last descending; ties end in the identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged


def _order(df: DataFrame, sort_by: str, key: str, descending: bool, default: str | None) -> list[Column]:
    column = sort_by if sort_by in df.columns else default or key
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), F.asc(key)]


def page(df: DataFrame, sort_by: str, key: str, descending: bool = False, number: int = 1, size: int = 50, default: str | None = None) -> DataFrame:
    """One page; an unknown column falls back to ``default``. Planned as a single top-k with offset."""
    return df.orderBy(*_order(df, sort_by, key, descending, default)).offset((number - 1) * size).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


class Ranked:
    """Rows written once in ranges of the order, so that any page, however deep, reads and sorts only the ranges it lies in.

    Ranges are cut by sampled values of the sort column and the key, so equal values are divided as well. What the driver
    holds is one count a range.
    """

    def __init__(self, df: DataFrame, sort_by: str, key: str, descending: bool = False, default: str | None = None, ranges: int = 64) -> None:
        self.order = _order(df, sort_by, key, descending, default)
        dealt = df.repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id())
        self.rows = staged(dealt, "ranked", "_range")
        counts = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        self.starts, self.total = {}, 0
        for part in sorted(counts):
            self.starts[part] = self.total
            self.total += counts[part]
        self.counts = counts

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """Rows numbered inside their range by a window; no row before the page leaves its task."""
        first = (number - 1) * size
        parts = [p for p, start in self.starts.items() if start < first + size and start + self.counts[p] > first]
        nth = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)) - 1
        start = F.element_at(F.create_map(*(F.lit(x) for p in parts for x in (p, self.starts[p]))), F.col("_range")) if parts else F.lit(0)
        rows = self.rows.filter(F.col("_range").isin(parts)).withColumn("_at", nth + start)
        return rows.filter(F.col("_at").between(first, first + size - 1)).orderBy("_at").drop("_at", "_range")
