"""Capture times: parsing, resolution, anomalies, shifts. All times are TIMESTAMP_NTZ; stored times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

OFFSET_HOURS = 8
# The two file-name patterns in the order they are tried.
NAME_PATTERNS = [
    r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[-_T](\d{2})[-_:](\d{2})[-_:](\d{2})",
    r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})",
]
COMPACT_PATTERN = r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"
_EXIF = r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def shifted(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def _timestamp(text: Column, pattern: str, in_range: bool) -> Column:
    """The match of a pattern of six fields, written as ISO and read. Each step is used once, so none is computed twice."""
    iso = F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, "$1-$2-$3 $4:$5:$6")
    if in_range:
        iso = F.regexp_extract(iso, "^(?:20[0-9]{2}|2100)-.*$", 0)
    return iso.try_cast("timestamp_ntz")


def exif_time(*tags: Column, offset_hours: int = OFFSET_HOURS) -> Column:
    """UTC time of the first tag that reads ``yyyy:MM:dd HH:mm:ss`` in local time."""
    return shifted(F.coalesce(*[_timestamp(F.trim(t), _EXIF, False) for t in tags]), -offset_hours)


def name_time(name: Column, offset_hours: int = OFFSET_HOURS, compact: bool = False) -> Column:
    """UTC time in a file name. ``yyyyMMdd_HHmmss`` fits neither pattern and counts only with ``compact``."""
    patterns = NAME_PATTERNS + [COMPACT_PATTERN] * compact
    return shifted(F.coalesce(*[_timestamp(name, p, True) for p in patterns]), -offset_hours)


def resolve(files: DataFrame, now: Column, offset_hours: int = OFFSET_HOURS) -> DataFrame:
    """Adds ``best_time`` and ``time_source`` from ``exif_time, file_name, file_modified, file_created``."""
    files = files.withColumn("_named", name_time(F.col("file_name"), offset_hours))
    modified, created = shifted(F.col("file_modified"), -offset_hours), shifted(F.col("file_created"), -offset_hours)
    source = (
        F.when(F.col("exif_time").isNotNull(), "exif")
        .when(F.col("_named").isNotNull(), "filename")
        .when(F.col("file_modified").isNotNull() | F.col("file_created").isNotNull(), "fs")
        .otherwise("unknown")
    )
    best = F.coalesce("exif_time", "_named", modified, created, now)
    return files.withColumns({"best_time": best, "time_source": source}).drop("_named")


def anomalies(now: Column, offset_hours: int = OFFSET_HOURS, hours: int = 24) -> Column:
    """Comma-joined codes of ``has_exif, best_time, exif_time, file_modified``; null if none applies."""
    day = F.make_dt_interval(days=F.lit(1))
    gap = F.make_dt_interval(hours=F.lit(hours))
    modified = shifted(F.col("file_modified"), -offset_hours)
    apart = (F.col("exif_time") > modified + gap) | (F.col("exif_time") < modified - gap)
    codes = [
        F.when(~F.coalesce(F.col("has_exif"), F.lit(False)), F.lit("no_exif")),
        F.when(F.col("best_time") > now + day, F.lit("future_time")),
        F.when(F.col("best_time") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.lit("too_old")),
        F.when(apart, F.lit("exif_fs_mismatch")),
    ]
    return F.nullif(F.concat_ws(",", *codes), F.lit(""))


def flagged(files: DataFrame, now: Column) -> DataFrame:
    """Rows with a code, as ``time_anomaly``. A filter on the codes would be pushed below them and compute them twice; a list
    of none or one code is unfolded instead.
    """
    return files.withColumn("time_anomaly", F.explode(F.array_compact(F.array(anomalies(now)))))


def offset_times(files: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Shifts ``exif_time`` and ``best_time`` (now where null) and flags anew. At most a year either way."""
    if abs(seconds) > 365 * 86400:
        raise ValueError("the offset is beyond 365 days")
    step = F.make_dt_interval(secs=F.lit(seconds))
    out = files.withColumns({"exif_time": F.col("exif_time") + step, "best_time": F.coalesce("best_time", now) + step})
    return out.withColumn("time_anomaly", anomalies(now))


def override_times(files: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """Applies ``overrides(file_id, new_time_utc)``: source ``manual``, counted as having EXIF."""
    out = files.join(overrides, "file_id", "left")
    new = F.col("new_time_utc")
    out = out.withColumns(
        {
            "exif_time": F.coalesce(new, "exif_time"),
            "best_time": F.coalesce(new, "best_time"),
            "has_exif": F.coalesce(new.isNotNull() | F.col("has_exif"), F.lit(False)),
            "time_source": F.when(new.isNotNull(), "manual").otherwise(F.col("time_source")),
        }
    )
    return out.withColumn("time_anomaly", anomalies(now)).drop("new_time_utc")


def display(ts: Column, offset_hours: int = OFFSET_HOURS) -> Column:
    return F.date_format(shifted(ts, offset_hours), "yyyy-MM-dd HH:mm:ss")


#: Accuracy of the sketch that brackets a quantile: its ranks are off by no more than one in so many rows.
SKETCH = 10_000


def exact_quartiles(times: DataFrame, accuracy: int = SKETCH) -> DataFrame:
    """``task_id, q1, q3``, interpolated, of ``task_id, s``; no task of Spark's holds or sorts all values of one ``task_id``.

    A mergeable sketch brackets each quartile; values below the bracket are only counted, and the few inside, which are
    made distinct first, are numbered exactly. Up to ``2 * accuracy`` values the bracket is their whole range. A bracket
    that misses its rank raises an error.
    """
    wide = 4.0 / accuracy
    points = F.array(*(F.lit(min(1.0, max(0.0, p + d))) for p in (0.25, 0.75) for d in (-wide, wide)))
    found = {"x": F.percentile_approx("s", points, accuracy), "n": F.count("s"), "least": F.min("s"), "most": F.max("s")}
    sketch = times.groupBy("task_id").agg(*(c.alias(name) for name, c in found.items())).filter("n > 0")
    few = F.col("n") <= 2 * accuracy
    sketch = sketch.withColumn("x", F.when(few, F.array("least", "most", "least", "most")).otherwise(F.col("x")))
    bracket = lambda q, p, i: F.struct(F.lit(q).alias("q"), ((F.col("n") - 1) * p).alias("rank"), F.get("x", F.lit(i)).alias("low"), F.get("x", F.lit(i + 1)).alias("high"))
    cuts = sketch.select("task_id", F.explode(F.array(bracket("q1", 0.25, 0), bracket("q3", 0.75, 2))).alias("c")).select("task_id", "c.*")
    near = times.join(cuts, "task_id").filter(F.col("s") <= F.col("high"))
    counted = near.withColumn("s", F.when(F.col("s") >= F.col("low"), F.col("s"))).groupBy("task_id", "q", "rank", "s").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("task_id", "q").orderBy(F.asc_nulls_first("s")))
    counted = counted.withColumn("upto", upto)
    at = lambda r: F.min(F.when((F.col("upto") > r) & F.col("s").isNotNull() & (F.col("upto") - F.col("k") <= r), F.col("s")))
    rank, low = F.col("rank"), F.floor("rank")
    ends = counted.groupBy("task_id", "q", "rank").agg(at(low).alias("a"), at(F.ceil("rank")).alias("b"))
    value = F.when(low == rank, F.col("a").cast("double")).otherwise((F.ceil("rank") - rank) * F.col("a") + (rank - low) * F.col("b"))
    ends = ends.withColumn("v", F.coalesce(value, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("v"))).alias(q)
    return ends.groupBy("task_id").agg(pick("q1"), pick("q3"))


def time_outliers(files: DataFrame, factor: float = 1.5) -> DataFrame:
    """Adds ``is_outlier``: best_time outside the quartiles by ``factor`` times their distance, per task; null without a time."""
    seconds = F.unix_micros(F.col("best_time").cast("timestamp"))
    times = staged(files.select("task_id", seconds.alias("s")).filter("s is not null"), "outlier-times")
    wide = (F.col("q3") - F.col("q1")) * factor
    bounds = exact_quartiles(times).select("task_id", (F.col("q1") - wide).alias("_least"), (F.col("q3") + wide).alias("_most"))
    out = files.join(bounds, "task_id", "left")
    return out.withColumn("is_outlier", (seconds < F.col("_least")) | (seconds > F.col("_most"))).drop("_least", "_most")
