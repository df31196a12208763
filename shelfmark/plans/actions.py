"""Action plans: the rows an executor would act on, with values before and after. Nothing here changes a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.formats import to_dms
from shelfmark.functions.paths import extension, has_extension, target_path
from shelfmark.scratch import staged

JPEG = [".jpg", ".jpeg"]


def delete_duplicates(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members marked for deletion, each file once even if it is in several groups."""
    wanted = members.filter("user_action = 'delete'").select("file_id").distinct()
    return files.join(wanted, "file_id", "left_semi")


def delete_by_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files deleted by the user, or by the model where the user said nothing."""
    wanted = labels.filter("user_label = 'delete' or (ai_prediction = 'delete' and user_label is null)").select("file_id", "task_id")
    return files.join(wanted.distinct(), ["file_id", "task_id"], "left_semi")


def without(table: DataFrame, plan: DataFrame) -> DataFrame:
    """What is left of a table once a plan has been carried out."""
    return table.join(plan.select("file_id").distinct(), "file_id", "left_anti")


def delete_by_extension(files: DataFrame, wanted: str) -> DataFrame:
    """Files of one extension; raises if there are none, as there is nothing to plan."""
    plan = files.filter(has_extension(F.col("extension"), wanted))
    if plan.isEmpty():
        raise ValueError(f"no file has the extension {wanted}")
    return plan


def write_positions(matches: DataFrame, files: DataFrame, fill_only: bool = True) -> DataFrame:
    """Matched positions with a decision: ``write_exif`` for JPEG, ``db_only`` else, ``skip`` where a position exists."""
    rows = matches.filter("match_quality != 'no_match'").join(files, "file_id")
    skip = F.col("original_has_gps") if fill_only else F.lit(False)
    jpeg = extension(F.col("file_name")).isin(JPEG)
    decision = F.when(F.coalesce(skip, F.lit(False)), "skip").when(jpeg, "write_exif").otherwise("db_only")
    return rows.withColumns(
        {"decision": decision, "lat_dms": to_dms(F.col("matched_lat"), "N", "S"), "lng_dms": to_dms(F.col("matched_lng"), "E", "W")}
    )


def apply_positions(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Catalog positions taken from the matches."""
    m = matches.filter("match_quality != 'no_match'").select("file_id", "matched_lat", "matched_lng")
    out = files.join(m, "file_id", "left")
    return out.withColumns(
        {
            "gps_lat": F.coalesce("matched_lat", "gps_lat"),
            "gps_lng": F.coalesce("matched_lng", "gps_lng"),
            "has_gps": F.coalesce(F.col("matched_lat").isNotNull() | F.col("has_gps"), F.lit(False)),
        }
    ).drop("matched_lat", "matched_lng")


def clear_positions(files: DataFrame) -> DataFrame:
    null = F.lit(None).cast("double")
    return files.withColumns({"gps_lat": null, "gps_lng": null, "has_gps": F.lit(False)})


def write_times(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new times of the files that change, and whether they can be written into the file."""
    new = after.select("file_id", F.col("best_time").alias("new_time"))
    rows = before.select("file_id", "file_name", F.col("best_time").alias("old_time")).join(new, "file_id")
    target = F.when(extension(F.col("file_name")).isin(JPEG), "jpeg").otherwise("db_only")
    return rows.filter("not (old_time <=> new_time)").withColumn("target", target)


#: A target's numbers are counted inside ranges of as many ids or numbers.
_RANGE_BITS = 16
_NUMBERED = r"^(.*)-([1-9][0-9]{0,17})((?:[.][^./]+)?)$"


def organise(files: DataFrame, rename: bool = False, offset_hours: int = 8) -> DataFrame:
    """Moves to ``yyyy/MM/name``, no two to one path. The first file of a target (by file_id) gets it; the others get the
    free ones of ``-1``, ``-2``, ... before the extension, those that are no file's own target.

    A number is free in itself: ``name-k`` arises from ``name`` alone. The n-th free number is n and as many more as there
    are taken numbers with fewer than n free ones below them. Files, and taken numbers among them, are counted inside
    ranges; running sums of the ranges' counts give the rest, so a target that very many files share is no single task.
    """
    target = target_path(F.col("best_time"), F.col("file_name"), offset_hours, rename)
    rows = files.filter("best_time is not null").withColumn("target", target)
    rows = staged(_counted_before(rows, ["target"], F.shiftright("file_id", _RANGE_BITS), "file_id", F.lit(1), "_n"), "organise")
    shared = rows.filter("_n > 0").select("target").distinct()
    part = lambda i: F.regexp_extract("target", _NUMBERED, i)
    taken = rows.filter("_n = 0").select(F.col("target").alias("_own"), F.concat(part(1), part(3)).alias("target"), part(2).try_cast("long").alias("_k"))
    taken = taken.filter((F.col("_k") > 0) & (_suffixed(F.col("target"), F.col("_k")) == F.col("_own"))).join(shared, "target", "left_semi")
    taken = _counted_before(taken, ["target"], F.shiftright("_k", _RANGE_BITS), "_k", F.lit(1), "_i").select("target", (F.col("_k") - F.col("_i") - 1).alias("_at"))

    crowded = rows.filter("_n > 0").join(taken.select("target").distinct(), "target", "left_semi").select("target", "_n")
    both = crowded.select("target", F.col("_n").alias("_at"), F.lit(0).alias("_taken")).unionByName(taken.withColumn("_taken", F.lit(1)))
    both = _counted_before(both, ["target"], F.shiftright("_at", _RANGE_BITS), ("_at", "_taken"), F.col("_taken"), "_more")
    more = both.filter("_taken = 0").select("target", F.col("_at").alias("_n"), "_more")
    rows = rows.join(more, ["target", "_n"], "left").withColumn("_n", F.col("_n") + F.coalesce("_more", F.lit(0)))
    return rows.withColumn("target", _suffixed(F.col("target"), F.col("_n"))).drop("_n", "_more")


def _counted_before(rows: DataFrame, key: list[str], part: Column, order: str | tuple[str, ...], what: Column, name: str) -> DataFrame:
    """Adds the sum of ``what`` over the rows of the key before each one, counted inside parts and added up over them."""
    order = [order] if isinstance(order, str) else list(order)
    rows = rows.withColumns({"_part": part, "_what": what.cast("long")})
    sums = rows.groupBy(*key, "_part").agg(F.sum("_what").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum("_what").over(inside), F.lit(0))).join(sums, [*key, "_part"])
    return rows.withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_what", "_start")


def _suffixed(target: Column, n: Column) -> Column:
    """``-n`` before the extension; names such as ``.profile`` have none."""
    ext = F.regexp_extract(target, r"[^./]([.][^./]+)$", 1)
    return F.when(n == 0, target).otherwise(F.concat(F.left(target, F.length(target) - F.length(ext)), F.lit("-"), n.cast("string"), ext))


def audit(plan: DataFrame, operation: str, now: Column, *details: str) -> DataFrame:
    """Log rows for a plan, its details as JSON."""
    return plan.select("task_id", F.lit(operation).alias("operation_type"), "file_path", F.to_json(F.struct(*details)).alias("detail"), now.alias("created_at"))


def audit_page(log: DataFrame, task_id: int | None = None, operation: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """Newest entries first, with the filters of the log view."""
    if task_id is not None:
        log = log.filter(F.col("task_id") == task_id)
    if operation is not None:
        log = log.filter(F.col("operation_type") == operation)
    return log.orderBy(F.desc("created_at"), F.desc("log_id")).offset((number - 1) * size).limit(size)
