"""Tracks: merging, the two-sided as-of match with interpolation, downsampling, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

GOOD_SECONDS = 300


def merge_tracks(points: DataFrame) -> DataFrame:
    """One point per exact time, of the first source and then the first point in it."""
    order = Window.partitionBy("task_id", "ts").orderBy("source_rank", "point_seq")
    return points.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _seconds(a: Column, b: Column) -> Column:
    """b - a in seconds."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


#: Rows that one range of times holds; a range never divides a second.
RANGE_ROWS = 500_000


def with_ranges(rows: DataFrame, time: str = "ts", most: int = RANGE_ROWS) -> DataFrame:
    """Adds ``bucket``, which rises with time: the day, and on days with more than ``most`` rows the part of it, so that no
    bucket holds many more rows than that.

    Rows are counted per day; those of busy days per second too, and running sums of these counts cut the day into parts
    of equal depth. Where no day is busy, nothing is joined.
    """
    day, second = F.date_trunc("day", time).cast("timestamp_ntz"), F.date_trunc("second", time).cast("timestamp_ntz")
    dated = rows.withColumn("_day", day)
    busy = staged(dated.groupBy("task_id", "_day").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n"), "busy-days")
    if busy.isEmpty():
        return dated.withColumn("bucket", F.struct(F.col("_day").alias("day"), F.lit(0).cast("long").alias("part"))).drop("_day")
    seconds = dated.join(busy, ["task_id", "_day"], "left_semi").groupBy("task_id", "_day", second.alias("_second")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("task_id", "_day").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1))  # at most 86,400 rows a day
    parts = seconds.select("task_id", "_day", "_second", F.floor(F.coalesce(before, F.lit(0)) / most).alias("_part"))
    cut = dated.withColumn("_second", second).join(parts, ["task_id", "_day", "_second"], "left")
    return cut.withColumn("bucket", F.struct(F.col("_day").alias("day"), F.coalesce("_part", F.lit(0)).cast("long").alias("part"))).drop("_day", "_second", "_part")


def match(photos: DataFrame, points: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """Adds ``matched_lat, matched_lng, time_offset_sec, match_quality`` to ``photos(task_id, file_id, ts)``.

    Points before (strictly) and after (or at) each photo come from two running windows inside ``(task, time range)``, whose
    ranges are days or parts of busy ones, so a long track is spread over the cluster, also if it lies in one hour; what
    lies in other ranges comes from a window over one row per range.
    Before the first and after the last point the position is clamped and the offset signed; in between it is
    interpolated and the offset is the distance to the nearer point. Without points: ``no_match``.
    """
    points = points.select("task_id", "ts", F.struct("ts", "lat", "lng").alias("p"))
    photos = photos.select("task_id", "ts", "file_id", *[c for c in photos.columns if c not in ("task_id", "ts", "file_id")])
    rest = photos.columns[2:]
    both = points.select("task_id", "ts", F.lit(1).alias("k"), "p", *[F.lit(None).cast(photos.schema[c].dataType).alias(c) for c in rest])
    both = both.unionByName(photos.select("task_id", "ts", F.lit(0).alias("k"), F.lit(None).cast(points.schema["p"].dataType).alias("p"), *rest))
    both = with_ranges(both, "ts", most)
    key = ["task_id", "bucket"]
    up = Window.partitionBy(*key).orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.last("p", ignorenulls=True).over(up)).withColumn("after", F.last("p", ignorenulls=True).over(down))
    found = both.filter("k = 0").drop("k", "p")

    ends = both.groupBy(*key).agg(F.min(F.when(F.col("k") == 1, F.col("p"))).alias("first"), F.max(F.when(F.col("k") == 1, F.col("p"))).alias("last"))
    earlier = Window.partitionBy("task_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("task_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, F.last("last", ignorenulls=True).over(earlier).alias("prev"), F.last("first", ignorenulls=True).over(later).alias("next"))
    found = found.join(ends, key).withColumns({"before": F.coalesce("before", "prev"), "after": F.coalesce("after", "next")})
    return _placed(found).drop("bucket", "before", "after", "prev", "next")


def _placed(found: DataFrame) -> DataFrame:
    b, a, t = F.col("before"), F.col("after"), F.col("ts")
    span, done = _seconds(b["ts"], a["ts"]), _seconds(b["ts"], t)
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(span == 0, 0.0).otherwise(done / F.when(span != 0, span))))
    mid = lambda c: b[c] + ratio * (a[c] - b[c])
    pick = lambda c: F.when(b.isNull(), a[c]).when(a.isNull(), b[c]).otherwise(mid(c))
    near = F.least(F.abs(_seconds(b["ts"], t)), F.abs(_seconds(a["ts"], t)))
    offset = F.when(b.isNull(), _seconds(a["ts"], t)).when(a.isNull(), _seconds(b["ts"], t)).otherwise(near).cast("long")
    found = found.withColumns({"matched_lat": pick("lat"), "matched_lng": pick("lng"), "time_offset_sec": offset})
    quality = F.when(b.isNull() & a.isNull(), "no_match").when(F.abs("time_offset_sec") <= GOOD_SECONDS, "good").otherwise("warning")
    return found.withColumn("match_quality", quality)


def match_stats(matches: DataFrame) -> DataFrame:
    """Counts by quality and of confirmed matches, per task."""
    n = lambda q: F.count_if(F.col("match_quality") == q)
    return matches.groupBy("task_id").agg(
        F.count("*").alias("total"), n("good").alias("good"), n("warning").alias("warning"), n("no_match").alias("no_match"),
        F.count_if(F.coalesce("user_confirmed", F.lit(False))).alias("confirmed"),
    )


def row_index(points: DataFrame, order: str = "ts", most: int = RANGE_ROWS) -> DataFrame:
    """Adds ``idx`` from 0 per task: counted inside time ranges, shifted by a running sum over the table of ranges."""
    rows = with_ranges(points, order, most).withColumnRenamed("bucket", "_b")
    sizes = rows.groupBy("task_id", "_b").agg(F.count("*").alias("_k"))
    before = Window.partitionBy("task_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("task_id", "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("task_id", "_b").orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(inside)).join(sizes, ["task_id", "_b"])
    return rows.withColumn("idx", F.col("_start") + F.col("_n") - 1).drop("_b", "_n", "_start")


def downsample(points: DataFrame, most: int = 2000) -> DataFrame:
    """All points of a task if there are at most ``most``, else rows ``int(i * n / most)`` and once more the last one."""
    rows = row_index(points)
    sizes = rows.groupBy("task_id").agg(F.count("*").alias("n"))
    wanted = sizes.select("task_id", "n", F.explode(F.when(F.col("n") <= most, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")))).alias("i"))
    idx = F.when(F.col("n") <= most, F.col("i")).when(F.col("i") == most, F.col("n") - 1).otherwise(F.expr(f"i * n div {most}"))
    wanted = wanted.select("task_id", "i", idx.alias("idx"))
    return wanted.join(rows, ["task_id", "idx"])


def project(points: DataFrame, width: float = 800.0, height: float = 600.0, padding: float = 32.0) -> DataFrame:
    """Adds ``x, y`` on a canvas: one scale for both axes, centred, y upwards; an empty range counts as 0.001 degrees."""
    box = points.groupBy("task_id").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lng").alias("lng0"), F.max("lng").alias("lng1"))
    span = lambda a, b: F.when(F.col(b) == F.col(a), F.lit(0.001)).otherwise(F.col(b) - F.col(a))
    box = box.withColumns({"rows": span("lat0", "lat1"), "cols": span("lng0", "lng1")})
    w, h = width - 2 * padding, height - 2 * padding
    box = box.withColumn("scale", F.least(F.lit(w) / F.col("cols"), F.lit(h) / F.col("rows")))
    left = F.lit(padding) + (F.lit(w) - F.col("cols") * F.col("scale")) / 2
    top = F.lit(padding) + (F.lit(h) - F.col("rows") * F.col("scale")) / 2
    out = points.join(box, "task_id")
    x, y = left + (F.col("lng") - F.col("lng0")) * F.col("scale"), top + (F.col("lat1") - F.col("lat")) * F.col("scale")
    return out.withColumns({"x": x, "y": y}).drop("lat0", "lat1", "lng0", "lng1", "rows", "cols", "scale")


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("task_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"), F.count("*").alias("points")
    )
