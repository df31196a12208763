"""Exact-duplicate funnel, keepers and group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.fingerprint import full_hash, quick_hash
from shelfmark.scratch import staged


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at least twice. Counts are combined before the shuffle; the join is split where keys are hot."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n >= 2").drop("_n")
    return df.join(many, keys, "left_semi")


#: Bits of one bitmap of Spark's, and the most bitmaps of a key filter: 16,384 of 4 KB, which is what is broadcast at most.
_BITS, FILTER_MAPS = 32768, 16_384


def key_filter(rows: DataFrame, keys: DataFrame, key: str = "file_id", maps: int = FILTER_MAPS, bits_a_key: int = 16) -> DataFrame:
    """Rows that may have one of the ``keys``: all that do, and few others. Nothing of the rows is shuffled.

    A Bloom filter with one hash: bitmaps of the keys' hashes, as many as the keys need up to ``maps``, whose size is thus
    bounded, are broadcast. With more keys it lets more rows through, but never loses one.
    """
    n = keys.agg(F.count(key)).first()[0]
    used = max(1, min(maps, -(-n * bits_a_key // _BITS)))
    spot = F.pmod(F.xxhash64(key), F.lit(used * _BITS))
    marked = keys.filter(F.col(key).isNotNull()).select(F.floor(spot / _BITS).alias("_map"), (spot % _BITS).alias("_bit"))
    marked = marked.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))  # at most ``used`` rows
    rows = rows.withColumns({"_spot": spot}).join(F.broadcast(marked), F.floor(F.col("_spot") / _BITS) == F.col("_map"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_spot") % _BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, (F.col("_spot") % 8).cast("int")) == 1).drop("_spot", "_map", "_bits")


def fingerprints(content: DataFrame, survivors: DataFrame, of) -> DataFrame:
    """``survivors`` with ``print``, computed by ``of`` where the contents are read; only hashes are joined and shuffled."""
    read = key_filter(content.filter("content is not null"), survivors.select("file_id"))
    return survivors.join(read.select("file_id", of(F.col("content")).alias("print")), "file_id")


def funnel(files: DataFrame, content: DataFrame) -> dict[str, DataFrame]:
    """Survivors of the three stages: equal sizes, equal quick hashes, equal SHA-256.

    ``files``: ``task_id, file_id, file_size``. ``content``: ``file_id, content``; it is read once for the quick hash and
    once for the full one, each time where it lies and only for files that are left. A null size or content drops out.
    Every stage is written to scratch once.
    """
    sizes = files.filter("file_size is not null").select("task_id", "file_id", "file_size")
    by_size = staged(_shared(sizes, ["task_id", "file_size"]), "funnel-size")
    quick = staged(fingerprints(content, by_size, quick_hash).withColumnRenamed("print", "quick"), "funnel-prints")
    by_quick = staged(_shared(quick, ["task_id", "file_size", "quick"]), "funnel-quick")
    full = staged(fingerprints(content, by_quick.drop("quick"), full_hash).withColumnRenamed("print", "sha256"), "funnel-prints")
    return {"size": by_size, "quick": by_quick, "full": staged(_shared(full, ["task_id", "sha256"]), "funnel-full")}


def keeper_order() -> Column:
    """The least of it is the file to keep: largest, with EXIF, shortest path, smallest id."""
    return F.struct(
        (-F.coalesce("file_size", F.lit(0))).alias("size"), (~F.coalesce("has_exif", F.lit(False))).alias("bare"), F.length("file_path").alias("path"), "file_id"
    )


def exact_members(files: DataFrame, content: DataFrame) -> DataFrame:
    """``task_id, group_id, file_id, file_size, is_recommended``; a group is named by its smallest file_id.

    Name and keeper are minima, combined before the shuffle and joined back, so a large group is never gathered in one task.
    """
    same = funnel(files, content)["full"].select("file_id", "sha256")
    rows = files.join(same, "file_id")
    first = rows.groupBy("task_id", "sha256").agg(F.min("file_id").alias("group_id"), F.min(keeper_order())["file_id"].alias("_keep"))
    rows = rows.join(first, ["task_id", "sha256"])
    return rows.withColumn("is_recommended", F.col("file_id") == F.col("_keep")).drop("_keep")


def recommended(members: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``is_recommended`` to members of any groups, by the same order as for exact ones."""
    rows = members.join(files.select("file_id", "file_size", "has_exif", "file_path"), "file_id")
    keep = rows.groupBy("task_id", "group_id").agg(F.min(keeper_order())["file_id"].alias("_keep"))
    return rows.join(keep, ["task_id", "group_id"]).withColumn("is_recommended", F.col("file_id") == F.col("_keep")).drop("_keep")


def groups(members: DataFrame, group_type: str, similarity: float | None) -> DataFrame:
    """One row per group: type, similarity, file count and the file to keep."""
    out = members.groupBy("task_id", "group_id").agg(
        F.count("*").alias("file_count"), F.max(F.when(F.col("is_recommended"), F.col("file_id"))).alias("recommended_keep_id")
    )
    return out.withColumns({"group_type": F.lit(group_type), "similarity": F.lit(similarity).cast("double")})


def group_table(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """Exact groups (similarity 1) and similar ones (similarity null) in one table, the latter named ``-1 - group_id``."""
    named = groups(similar, "similar", None).withColumn("group_id", -1 - F.col("group_id"))
    return groups(exact, "exact", 1.0).unionByName(named)


def funnel_counts(files: DataFrame, content: DataFrame) -> DataFrame:
    """How many files are left after each stage."""
    stages = funnel(files, content)
    out = None
    for n, name in enumerate(("size", "quick", "full"), 1):
        row = stages[name].agg(F.count("*").alias("files")).select(F.lit(n).alias("stage"), F.lit(name).alias("name"), "files")
        out = row if out is None else out.unionByName(row)
    return out


def reclaimable(members: DataFrame) -> DataFrame:
    """Groups, files and bytes beyond the largest file of each group, over all groups."""
    per = members.groupBy("task_id", "group_id").agg(
        F.count("*").alias("n"), (F.sum(F.coalesce("file_size", F.lit(0))) - F.max(F.coalesce("file_size", F.lit(0)))).alias("bytes")
    )
    return per.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).withColumn("mb", F.round(F.col("bytes") / 1048576.0, 2))


def accept(members: DataFrame) -> DataFrame:
    """The recommendation taken as the user's action."""
    return members.withColumn("user_action", F.when(F.col("is_recommended"), "keep").otherwise("delete"))


def uncovered(similar: DataFrame, exact: DataFrame) -> DataFrame:
    """Similar groups without those whose every member is in some exact group; members are never removed singly."""
    marked = similar.join(exact.select("file_id", F.lit(True).alias("_exact")).distinct(), "file_id", "left")
    left = marked.groupBy("task_id", "group_id").agg(F.bool_and(F.coalesce("_exact", F.lit(False))).alias("_all")).filter("not _all")
    return similar.join(left.drop("_all"), ["task_id", "group_id"], "left_semi")


def summary(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """Groups and files of both kinds; a file in both counts twice."""

    def one(members: DataFrame, kind: str) -> DataFrame:
        return members.agg(F.count_distinct("task_id", "group_id").alias("groups"), F.count("*").alias("files")).withColumn("kind", F.lit(kind))

    return one(exact, "exact").unionByName(one(similar, "similar"))
