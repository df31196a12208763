"""Fingerprints and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 8192


def quick_hash(content: Column) -> Column:
    """XXH64 of the first 8 KB, followed by the last 8 KB only where there are more than 16 KB."""
    data = content.cast("binary")
    tail = F.when(F.octet_length(data) > 2 * CHUNK, F.substring(data, -CHUNK, CHUNK)).otherwise(F.lit(b""))
    return F.xxhash64(F.concat(F.substring(data, 1, CHUNK), tail))


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def difference_hash(pixels: Column) -> Column:
    """64 bits of an 8 x 9 row-major grid: left pixel greater than its right neighbour, first pair highest."""
    bit = lambda i: (F.get(pixels, i + F.floor(i / 8).cast("int")) > F.get(pixels, i + F.floor(i / 8).cast("int") + 1)).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(i)))


def ring_hash(vector: Column) -> Column:
    """64 bits of a vector of 64 numbers: each greater than its successor, the last compared with the first."""
    bit = lambda i: (F.get(vector, i) > F.get(vector, F.pmod(i + 1, F.lit(64)))).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(i)))


def hex_to_bits(text: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unit_length(vector: Column) -> Column:
    """The vector divided by its Euclidean length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / norm)
