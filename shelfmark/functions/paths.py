"""Paths, names and file classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by class.
IMAGE = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".avif", ".bmp", ".tiff", ".tif", ".gif"]
VIDEO = [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".mts", ".m2ts"]
RAW = [".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".dng", ".raf"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case last suffix with its dot; null where there is none, also for ``.bashrc`` and for a closing dot."""
    return F.lower(F.nullif(F.regexp_extract(name, r"^.*[^.](\.[^.]+)$", 1), F.lit("")))


def relative_path(path: Column, root: Column) -> Column:
    """What follows ``root/``; the path itself if it is not below the root."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def file_type(ext: Column) -> Column:
    return F.when(ext.isin(IMAGE), "image").when(ext.isin(VIDEO), "video").when(ext.isin(RAW), "raw").otherwise("other")


def mime_type(ext: Column) -> Column:
    bare = F.substring(ext, 2, 100)
    return (
        F.when(ext.isin(IMAGE + RAW), F.concat(F.lit("image/"), bare))
        .when(ext.isin(VIDEO), F.concat(F.lit("video/"), bare))
        .otherwise("application/octet-stream")
    )


def classify(files: DataFrame) -> DataFrame:
    """Adds ``extension, file_type, mime_type`` from ``file_name``."""
    ext = extension(F.col("file_name"))
    return files.withColumn("extension", ext).withColumns({"file_type": file_type(F.col("extension")), "mime_type": mime_type(F.col("extension"))})


def has_extension(ext: Column, wanted: str) -> Column:
    """Case-insensitive; the wanted extension may come with or without its dot."""
    return F.lower(ext) == ("." + wanted.lower().lstrip("."))


def target_path(best_time_utc: Column, name: Column, offset_hours: int = 8, rename: bool = False) -> Column:
    """``yyyy/MM/name`` by local time; renamed to the time with the old extension on request."""
    local = best_time_utc + F.make_dt_interval(hours=F.lit(offset_hours))
    new = F.concat(F.date_format(local, "yyyyMMdd_HHmmss"), F.coalesce(extension(name), F.lit(""))) if rename else name
    return F.concat_ws("/", F.date_format(local, "yyyy"), F.date_format(local, "MM"), new)


def empty_directories(listing: DataFrame) -> DataFrame:
    """``path, depth`` of directories (``is_dir``) with nothing but directories below them, deepest first.

    ``listing`` has relative paths; the root itself is not listed. Ancestors are made distinct before the anti join.
    """
    parts = F.split("path", "/")
    files = listing.filter("not is_dir").select(parts.alias("p")).filter("size(p) > 1")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat_ws("/", F.slice("p", F.lit(1), i)))
    full = files.select(F.explode(prefixes).alias("path")).distinct()
    dirs = listing.filter("is_dir and path != ''").select("path").distinct()
    return dirs.join(full, "path", "left_anti").withColumn("depth", F.size(parts)).orderBy(F.desc("depth"), F.lower("path"), "path")
