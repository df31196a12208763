"""Numbers for people to read, and coordinates in degrees, minutes and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_text(size: Column) -> Column:
    """B, KB or MB with one decimal; a dash for null or 0."""
    return (
        F.when(size.isNull() | (size == 0), "-")
        .when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024.0))
        .otherwise(F.format_string("%.1f MB", size / 1048576.0))
    )


def offset_text(seconds: Column) -> Column:
    """Signed ``XhYm``, ``XmYs`` or ``Xs``; a dash for null."""
    sign, a = F.when(seconds >= 0, "+").otherwise("-"), F.abs(seconds)
    div = lambda x, n: F.floor(x / n).cast("long")
    text = (
        F.when(a >= 3600, F.format_string("%dh%dm", div(a, 3600), div(a % 3600, 60)))
        .when(a >= 60, F.format_string("%dm%ds", div(a, 60), (a % 60).cast("long")))
        .otherwise(F.format_string("%ds", a.cast("long")))
    )
    return F.when(seconds.isNull(), "-").otherwise(F.concat(sign, text))


def coordinate_text(lat: Column, lng: Column) -> Column:
    """Both coordinates with six decimals; a dash if one is null."""
    return F.when(lat.isNull() | lng.isNull(), "-").otherwise(F.format_string("%.6f, %.6f", lat, lng))


def to_dms(degrees: Column, positive: str, negative: str) -> Column:
    """Struct of whole degrees, whole minutes, seconds in ten-thousandths (half-even) and the hemisphere.

    Seconds may come out as 600000, which is 60 seconds, and stay so.
    """
    a = F.abs(degrees)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.bround(((a - d) * 60 - m) * 60 * 10000, 0).cast("long")
    ref = F.when(degrees >= 0, positive).otherwise(negative)
    return F.struct(d.cast("long").alias("d"), m.cast("long").alias("m"), s.alias("s10000"), ref.alias("ref"))
